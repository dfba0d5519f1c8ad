"""Composable polynomial fingerprints and exact duplicate groups.

``H(s) = sum s[i] * B^(n-1-i) mod p`` over a text's bytes, for two primes.
Chunk hashes are independent of each other and compose by shifting with the
length of what follows: ``H(xy) = H(x) * B^len(y) + H(y)``.

``exact_groups`` reads each text once and stores its chunks, each with its
hash and length.  A grouped aggregate composes the hashes of the documents of
several chunks; equal fingerprints are only candidates, so their lists of
chunk hashes must be equal as well, and the stored chunks are compared byte by
byte: chunks of one hash and length meet in a grouped count of different
chunks (copies collapse before the shuffle, so a text with millions of copies
sends one row per task).  A hash with two different chunks is a collision, and
documents that hold such a chunk are grouped by their digest as well.

``keep_one`` carries whole rows, so there hashes are composed beside the text
and compared by fingerprint and position.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import bound_batches, column, id_text, stored, trim
from tillbook.operators.skew import join_per_key

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245 % 2_147_483_647, 741_103_597)
CHUNK_BYTES = 1 << 16      # 8-bit x 31-bit products, summed 2^16 times: under 2^63
OUT_BYTES = 8 << 20        # of chunks per output batch
KEY = ["fp", "n_bytes"]

_POWERS: dict[int, list] = {}


def powers(size: int) -> list:
    """``B^(size-1) .. B^0`` for both primes."""
    import numpy as np
    if size not in _POWERS:
        tables = []
        for p, b in zip(PRIMES, BASES):
            table = np.ones(1, dtype=np.uint64)
            while len(table) < size:         # doubling: the lower half shifted up
                shift = np.uint64(pow(b, len(table), p))
                table = np.concatenate([table * shift % np.uint64(p), table])
            tables.append(table[-size:])
        _POWERS[size] = tables
    return _POWERS[size]


def chunk_hashes(data: bytes, chunk: int = CHUNK_BYTES) -> list[tuple[int, int, int]]:
    """(hash mod p1, hash mod p2, length) of each chunk of ``data``, all
    whole chunks at once."""
    import numpy as np
    table = powers(chunk)
    whole = len(data) // chunk
    out: list[tuple[int, int, int]] = []
    for at in range(0, whole, 16):           # at most 16 chunks widened to 64 bits at once
        rows = np.frombuffer(data, np.uint8, min(16, whole - at) * chunk, at * chunk)
        rows = rows.reshape(-1, chunk).astype(np.uint64)
        h = [(rows @ t % np.uint64(p)).tolist() for t, p in zip(table, PRIMES)]
        out += [(a, b, chunk) for a, b in zip(*h)]
    rest = len(data) - whole * chunk
    if rest:
        row = np.frombuffer(data, np.uint8, rest, whole * chunk).astype(np.uint64)
        out.append((*(int(row @ t[-rest:]) % p for t, p in zip(table, PRIMES)), rest))
    return out


def compose(parts: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The hash of the concatenation of texts with the given hashes."""
    h, n = [0, 0], 0
    for *part, size in parts:
        h = [(x * pow(b, size, p) + y) % p for x, y, b, p in zip(h, part, BASES, PRIMES)]
        n += size
    return h[0], h[1], n


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed; null is empty."""
    return text.encode("utf-8").lower() if text else b""


def fingerprint(data: bytes) -> int:
    """Both hashes in one signed 64-bit number."""
    a, b, _ = compose(chunk_hashes(data))
    return a << 31 | b


def _fingerprint_udf(hash_fn=fingerprint):
    @F.arrow_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("n_bytes", T.LongType()),
                               T.StructField("sha256", T.StringType())]))
    def fingerprints(text):
        import pyarrow as pa
        fp, size, sha = [], [], []
        for value in text:
            data = normalised(value.as_py())
            fp.append(hash_fn(data))
            size.append(len(data))
            sha.append(hashlib.sha256(data).hexdigest())
        trim()
        return pa.StructArray.from_arrays(
            [pa.array(fp, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())],
            names=["fp", "n_bytes", "sha256"])
    return fingerprints.asNondeterministic()    # not evaluated again above its projection


def _collisions(rows: DataFrame, hash_fn=fingerprint) -> DataFrame:
    """Fingerprints (with length) under which two texts differ in a chunk."""
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        out, size = [], 0

        def flush():
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=schema.names)
            out.clear()
            size = 0
            return batch

        for batch in batches:
            for value in batch.column(0):
                data = normalised(value.as_py())
                fp = hash_fn(data)
                for no, at in enumerate(range(0, len(data), CHUNK_BYTES)):
                    out.append((fp, len(data), no, data[at:at + CHUNK_BYTES]))
                    size += len(out[-1][3])
                    if size > OUT_BYTES:
                        yield flush()
        if out:
            yield flush()
        trim()

    different = (rows.select("text").mapInArrow(run, schema)
                 .groupBy(*KEY, "chunk_no", "chunk").agg(F.lit(1).alias("one"))
                 .groupBy(*KEY, "chunk_no").agg(F.count("one").alias("n")))
    return different.filter("n > 1").select(*KEY).distinct()


def _chunk_rows(rows: DataFrame, hash_fn=fingerprint) -> DataFrame:
    """One row per chunk, one at least per text: the text's ``row_no``,
    ``doc_id``, ``n_bytes``, ``n_chunks`` and (in its first chunk's row)
    ``sha256``; ``chunk_no``, both hashes ``a`` and ``b``, the factors that
    shift what stands before, ``size`` and the ``chunk``.

    ``row_no`` counts the texts of a task: store the result before use."""
    fields = [("row_no", T.LongType()), ("doc_id", rows.schema["doc_id"].dataType), ("n_bytes", T.LongType()),
              ("n_chunks", T.IntegerType()), ("sha256", T.StringType()), ("chunk_no", T.IntegerType()),
              ("a", T.LongType()), ("b", T.LongType()), ("shift_a", T.LongType()), ("shift_b", T.LongType()),
              ("size", T.IntegerType()), ("chunk", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    own = hash_fn is fingerprint

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        row_no = TaskContext.get().partitionId() << 33
        shifts = {n: tuple(pow(b, n, p) for b, p in zip(BASES, PRIMES)) for n in (0, CHUNK_BYTES)}
        out, size = [], 0

        def flush():
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            size = 0
            return batch

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = normalised(value.as_py())
                cuts = range(0, len(data), CHUNK_BYTES) or (0,)
                if own:
                    parts = chunk_hashes(data) or [(0, 0, 0)]
                else:
                    parts = [(h >> 31, h & (1 << 31) - 1, len(data[at:at + CHUNK_BYTES]))
                             for at in cuts for h in [hash_fn(data[at:at + CHUNK_BYTES])]]
                sha = hashlib.sha256(data).hexdigest()
                for no, (at, (a, b, n)) in enumerate(zip(cuts, parts)):
                    shift = shifts.get(n) or tuple(pow(base, n, p) for base, p in zip(BASES, PRIMES))
                    out.append((row_no, doc_id, len(data), len(cuts), None if no else sha, no, a, b, *shift, n,
                                data[at:at + CHUNK_BYTES]))
                    size += n + 200
                    if size > OUT_BYTES:
                        yield flush()
                row_no += 1
        if out:
            yield flush()
        trim()

    return rows.select("doc_id", "text").mapInArrow(run, schema)


def _composed(chunks: DataFrame) -> DataFrame:
    """``row_no``, ``doc_id``, ``n_bytes``, ``sha256``, the fingerprint ``fp``
    and, for texts of several chunks, the list of their hashes as text."""
    both = F.shiftleft(F.col("a"), 31).bitwiseOR(F.col("b"))
    one = chunks.filter("n_chunks = 1").select("row_no", "doc_id", "n_bytes", "sha256", both.alias("fp"),
                                               F.lit("").alias("parts"))
    # a text has at most 2^31 bytes, so a list has at most 2^15 hashes
    lists = (chunks.filter("n_chunks > 1").groupBy("row_no", "doc_id", "n_bytes")
             .agg(F.max("sha256").alias("sha256"),
                  F.sort_array(F.collect_list(F.struct("chunk_no", "a", "b", "shift_a", "shift_b"))).alias("c")))
    zero = F.lit(0).cast("long")
    composed = F.aggregate(
        "c", F.struct(zero.alias("a"), zero.alias("b")),
        lambda h, c: F.struct(((h["a"] * c["shift_a"] + c["a"]) % F.lit(PRIMES[0]).cast("long")).alias("a"),
                              ((h["b"] * c["shift_b"] + c["b"]) % F.lit(PRIMES[1]).cast("long")).alias("b")),
        lambda h: F.shiftleft(h["a"], 31).bitwiseOR(h["b"]))
    parts = F.array_join(F.transform("c", lambda c: F.concat_ws(".", c["a"].cast("string"), c["b"].cast("string"))), ",")
    many = lists.select("row_no", "doc_id", "n_bytes", "sha256", composed.alias("fp"), parts.alias("parts"))
    return one.unionByName(many)


def _grouped(rows: DataFrame, hash_fn=fingerprint) -> tuple[DataFrame, DataFrame]:
    """Per distinct (doc_id, text): key, digest and row count; and per text:
    key, group size and the id that stays."""
    bound_batches(rows.sparkSession)
    chunks = stored(_chunk_rows(rows, hash_fn), "chunks")
    texts = _composed(chunks)
    chunk_key = ["a", "b", "size"]
    bad = stored(chunks.groupBy(*chunk_key, "chunk").agg(F.lit(1).alias("one"))
                 .groupBy(*chunk_key).agg(F.count("one").alias("n")).filter("n > 1").select(*chunk_key), "chunk-collisions")
    if bad.isEmpty():
        texts = texts.withColumn("variant", F.col("parts"))
    else:
        hit = (join_per_key(chunks.select("row_no", *chunk_key), bad.withColumn("collided", F.lit(True)), chunk_key, "inner")
               .groupBy("row_no").agg(F.first("collided").alias("collided")))
        texts = (texts.join(hit, "row_no", "left")
                 .withColumn("variant", F.concat("parts", F.when(F.col("collided"), F.col("sha256")).otherwise(F.lit("")))))
    counted = stored(texts.groupBy("doc_id", *KEY, "variant", "sha256").agg(F.count(F.lit(1)).alias("copies")),
                     "fingerprints")
    groups = counted.groupBy(*KEY, "variant").agg(F.sum("copies").alias("group_size"),
                                                  F.max("doc_id").alias("keep_id"))
    return counted, groups


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash_fn=fingerprint) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z.

    One row per row of ``docs``: ``doc_id``, ``keep_id`` (largest id of the
    group), ``group_size``, ``kept``, ``text_sha256`` (of the normalised
    text).  A null text counts as empty and groups with empty texts.  Exactly
    one row of a group is kept: of repeated rows with the largest id, one.
    A null id is never the largest; in a group of null ids only, one row is
    kept and ``keep_id`` is null.  An empty table gives no rows; other
    columns are ignored.  ``hash_fn`` replaces the hash of a chunk (tests
    force collisions with it).
    """
    counted, groups = _grouped(id_text(docs, id_col, text_col), hash_fn)
    return (join_per_key(counted, groups, [*KEY, "variant"], "inner")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    F.col("sha256").alias("text_sha256")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=fingerprint) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_groups`` keeps.

    Every task first keeps the largest id of each of its groups, so a text
    with very many copies is shuffled once per task.  Rows are joined to the
    collided fingerprints only where there are any.  Nulls, repeated rows and
    empty tables as in ``exact_groups``."""
    bound_batches(docs.sparkSession)
    collided = stored(_collisions(id_text(docs, id_col, text_col), hash_fn), "collisions")
    rows = (docs.select(F.struct(*[column(c).alias(f"d{i}") for i, c in enumerate(docs.columns)]).alias("row"),
                        column(id_col).alias("doc_id"),
                        _fingerprint_udf(hash_fn)(column(text_col).cast("string")).alias("f"))
            .select("row", "doc_id", "f.*"))
    if collided.isEmpty():
        rows = rows.withColumn("variant", F.lit(""))
    else:
        rows = (rows.join(collided.withColumn("collided", F.lit(True)), KEY, "left")
                .withColumn("variant", F.when(F.col("collided"), F.col("sha256")).otherwise(F.lit(""))))
    # an id counts more than none, a larger one more than a smaller one
    largest = F.max_by("row", F.struct(F.col("doc_id").isNotNull(), F.col("doc_id")))
    kept = rows.groupBy(*KEY, "variant").agg(largest.alias("row"))
    return kept.select(*[F.col(f"row.d{i}").alias(c) for i, c in enumerate(docs.columns)])
