"""Token counts from distinct pre-tokens (see ``chunk_table``).

Each distinct chunk is segmented once to count its pieces; a document's
count is the sum over its chunk frequencies.  No document's ids exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillbook.llm import chunk_table
from tillbook.llm.chunk_table import by_place, unpacked, unpacked_places
from tillbook.llm.common import trim


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row of ``docs``.

    Equals the length of the library's ``encode`` of the whole text without
    begin or end ids.  A null or empty text has 0 bytes and 0 tokens; null
    ids and repeated rows are kept as they are; an empty table gives no rows;
    other columns are ignored.
    """
    block_rows = chunk_table.blocks(docs, id_col, text_col, frequencies=True)
    joined = chunk_table.answered(block_rows, model, ids=False).select(
        "doc_ids", "n_bytes", "n_places", "places", "times", "word_buckets", "answers")
    schema = T.StructType([
        T.StructField("doc_id", block_rows.schema["doc_ids"].dataType.elementType),
        T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, n_bytes, n_places = (batch.column(c)[i].values for c in range(3))
                places, times = unpacked_places(batch.column(3)[i].as_py()), unpacked(batch.column(4)[i].as_py(), "<u4")
                n, _ = by_place(batch.column(5)[i].as_py(), [a["sizes"] for a in batch.column(6)[i].as_py() or []])
                ends = np.cumsum(n_places.to_numpy())
                sums = np.concatenate([[0], np.cumsum(n[places] * times)])
                total = sums[ends] - sums[ends - n_places.to_numpy()]
                yield pa.RecordBatch.from_arrays([doc_ids, n_bytes, pa.array(total, pa.int64())], names=schema.names)
        trim()

    return joined.mapInArrow(run, schema)
