"""Helpers shared by the operators of this package."""

from __future__ import annotations

import functools
import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.session import scratch_path


BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def bound_batches(spark) -> None:
    """Rows go to Python workers in batches of about ``BATCH_BYTES``, unless
    the session names a limit of its own.

    Spark's default is 10 000 rows or 64 MB, whichever comes first; buffers of
    that size stay with the executor, outside its heap, after the task."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Two consumers then see the same rows, and a lost executor re-reads the
    table instead of recomputing its lineage.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column called exactly ``name``, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that
    other columns of ``docs`` can have any name."""
    return docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(array, size: int):
    """Slices of an Arrow string array of about ``size`` bytes, one text at
    least, so that working copies of a batch stay small."""
    import numpy as np
    import pyarrow.compute as pc
    ends = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(array):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield array.slice(lo, hi - lo)
        lo = hi


@functools.cache
def loaded_tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker process: the library
    keeps the word cache of every tokenizer that was used, dropped ones too,
    so one per task would make a worker grow with its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def trim() -> None:
    """Give freed memory of a Python worker back to the machine: workers
    are kept for later tasks, beside the executor's heap."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):      # another C library
        pass
