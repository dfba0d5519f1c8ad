"""Distinct white-space-marked words of a corpus, joined back by place.

SentencePiece turns a space into the marker U+2581.  For a vocabulary whose
pieces hold the marker at their start only, hold no line feed and never mix
letters with other characters (``check_vocabulary`` makes sure), no merge
reaches over a word's end into the next marker, over a line feed, or between
a word and its punctuation.  So a text can be cut there, each
distinct chunk segmented once, and the parts put together again.

1. ``blocks``: each task reads its documents in blocks of a bounded number
   of characters and writes one row per block: the block's distinct chunks
   (its dictionary) and, per document, the places in that dictionary.
2. ``segmented``: dictionaries are dealt by a hash of the chunk into buckets;
   one row carries a block's chunks of one bucket.  In a bucket
   each distinct chunk is segmented once, for every block that asked.  A
   chunk occurs once per block at most, however frequent it is in the texts,
   so no chunk is hot.  ``spread`` takes the numbers of buckets and of tasks
   from the size of all dictionaries, so that a task's share stays bounded
   while the input grows.
3. The answers go back to their block (one block's dictionary is bounded by
   the block size) and are put in place there.

The blocks are written to the shared checkpoint folder, since steps 2 and 3
must see the same dictionaries.  Arrays and word lists are compressed: the
shuffles carry about two bytes per chunk of text.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import id_text, stored, trim

BLOCK_CHARS = 32 << 20     # a block is closed at this many characters
BLOCK_DOCS = 1 << 16       # ... or documents
TASK_BYTES = 32 << 20      # of packed dictionaries, segmented by one task
LEAST_BUCKETS = 1024
BUCKETS_PER_TASK = 4
KNOWN_CHUNKS = 2_000_000  # of a bucket, remembered at once
MARK = "▁"
# letters are word characters but digits, underscores and raised or broken numbers
_OTHER = r"\W\d_²³¹¼½¾⁰-₟"
CHUNK = re.compile(rf" *[^{_OTHER}]+| *(?:(?![ \n])[{_OTHER}])+| +|\n")
_MIXED = re.compile(rf"[{_OTHER}][^{_OTHER}]|[^{_OTHER}][{_OTHER}]")


def processors(path: str):
    """The model as it is, and a copy that adds no marker in front."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    full = sentencepiece.SentencePieceProcessor()
    full.LoadFromSerializedProto(model.SerializeToString())
    check_vocabulary(model)
    model.normalizer_spec.add_dummy_prefix = False
    bare = sentencepiece.SentencePieceProcessor()
    bare.LoadFromSerializedProto(model.SerializeToString())
    return full, bare


def check_vocabulary(model) -> None:
    """Raise unless cutting a text into chunks is exact for the model."""
    n = model.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix \
            or not n.escape_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError("the model normalises text; chunks would differ")
    for p in model.pieces:
        body = p.piece.lstrip(MARK)
        if p.type == p.USER_DEFINED or p.type == p.NORMAL and (MARK in body or "\n" in body or _MIXED.search(body)):
            raise ValueError(f"piece {p.piece!r} can cross a chunk's end")


def chunks(text: str | None) -> list[str]:
    """The chunks of a text, with the marker the library adds in front."""
    return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def packed(array) -> bytes:
    """A numpy array byte plane by byte plane, compressed."""
    import numpy as np
    import zstandard
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(-1, array.itemsize).T)
    return zstandard.ZstdCompressor(level=9).compress(planes.tobytes())


def unpacked(data: bytes, kind: str):
    import numpy as np
    import zstandard
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def packed_places(array) -> bytes:
    """Places, the frequent ones small: one byte each, 255 for what follows
    in full after them."""
    import numpy as np
    import zstandard
    low = zstandard.ZstdCompressor(level=9).compress(np.minimum(array, 255).astype(np.uint8).tobytes())
    return len(low).to_bytes(8, "little") + low + packed(array[array >= 255])


def unpacked_places(data: bytes):
    import numpy as np
    import zstandard
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:8 + n]), np.uint8).astype("<u4")
    out[out == 255] = unpacked(data[8 + n:], "<u4")
    return out


def packed_words(words: list[str]) -> bytes:
    """A line feed occurs in no chunk but the one that is a line feed, which
    is stored as an empty line."""
    import zstandard
    return zstandard.ZstdCompressor(level=9).compress(
        "\n".join(["" if w == "\n" else w for w in words]).encode("utf-8"))


def unpacked_words(data: bytes) -> list[str]:
    import zstandard
    return [w or "\n" for w in zstandard.ZstdDecompressor().decompress(data).decode("utf-8").split("\n")]


def blocks(docs: DataFrame, id_col: str, text_col: str, frequencies: bool) -> DataFrame:
    """One row per block: ``block_id``, ``words`` (null for none),
    ``words_bytes`` (their packed size), and per document ``doc_ids``, ``n_bytes``, ``n_places`` with the places in
    ``words`` one after the other in ``places``; with ``frequencies`` each
    place occurs once per document and ``times`` says how often."""
    rows = id_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("block_id", T.LongType()), T.StructField("words", T.BinaryType()),
        T.StructField("words_bytes", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("n_bytes", T.ArrayType(T.LongType())), T.StructField("n_places", T.ArrayType(T.LongType())),
        T.StructField("places", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        block = TaskContext.get().partitionId() << 32
        words: dict[str, int] = {}
        doc_ids, n_bytes, n_places, places, times, size = [], [], [], [], [], 0

        def close():
            at, names = np.concatenate(places), list(words)
            # the most frequent chunks get the smallest numbers
            order = np.argsort(-np.bincount(at, minlength=len(names)), kind="stable")
            rank = np.empty(len(names), dtype="<u4")
            rank[order] = np.arange(len(names))
            names = [names[i] for i in order.tolist()]
            held = packed_words(names) if names else None
            row = (block, held, len(held or b""), doc_ids, n_bytes, n_places,
                   packed_places(rank[at]), packed(np.concatenate(times)) if frequencies else None)
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                parts = chunks(text)
                for w in set(parts).difference(words):
                    words[w] = len(words)
                at = np.array([words[w] for w in parts], dtype="<u4")
                if frequencies:
                    at, n = np.unique(at, return_counts=True)
                    times.append(n.astype("<u4"))
                places.append(at)
                doc_ids.append(doc_id)
                n_bytes.append(len(text.encode("utf-8")))
                n_places.append(len(at))
                size += len(text)
                if size >= BLOCK_CHARS or len(doc_ids) >= BLOCK_DOCS:
                    yield close()
                    block += 1
                    words = {}
                    doc_ids, n_bytes, n_places, places, times, size = [], [], [], [], [], 0
                    trim()
        if doc_ids:
            yield close()
        words, places, times = {}, [], []
        trim()

    return stored(rows.mapInArrow(run, schema), "chunk-blocks")


def spread(block_rows: DataFrame) -> tuple[int, int]:
    """(buckets, tasks) for the dictionaries of ``block_rows``."""
    total = block_rows.agg(F.sum("words_bytes")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    return max(LEAST_BUCKETS, BUCKETS_PER_TASK * tasks), tasks


def buckets_of(words: list[str], buckets: int):
    import numpy as np
    return np.fromiter((zlib.crc32(w.encode("utf-8")) % buckets for w in words), dtype="<u4", count=len(words))


def segmented(block_rows: DataFrame, model: str, ids: bool, buckets: int, tasks: int) -> DataFrame:
    """``block_id``, ``bucket``, ``sizes`` (pieces per chunk, packed) for every
    block and bucket, in the block's order of words; with ``ids`` also the
    ``ids`` of the chunks one after the other (packed)."""
    fields = [T.StructField("block_id", T.LongType()), T.StructField("bucket", T.IntegerType()),
              T.StructField("sizes", T.BinaryType())] + [T.StructField("ids", T.BinaryType())] * ids
    schema = T.StructType(fields)

    def ask(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for block, words in zip(*(c.to_pylist() for c in batch.columns)):
                words = unpacked_words(words) if words else []
                by = buckets_of(words, buckets)
                order = np.argsort(by, kind="stable")
                there, starts = np.unique(by[order], return_index=True)
                parts = [packed_words([words[i] for i in at.tolist()]) for at in np.split(order, starts[1:])] \
                    if words else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there.tolist(), pa.int32()), pa.array([block] * len(parts), pa.int64()),
                     pa.array(parts, pa.binary())], names=["bucket", "block_id", "words"])

    def answer(batches):
        import numpy as np
        import pyarrow as pa
        _, bare = processors(model)
        now, known = None, {}
        for batch in batches:
            out = []
            for bucket, block, words in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now or len(known) > KNOWN_CHUNKS:
                    now, known = bucket, {}       # the rows are sorted by bucket
                words = unpacked_words(words)
                new = [w for w in words if w not in known]
                for w, e in zip(new, bare.encode(new, num_threads=1) if new else []):
                    known[w] = np.array(e, dtype="<u4") if ids else len(e)
                found = [known[w] for w in words]
                if ids:
                    out.append((block, bucket, packed(np.array([len(e) for e in found], dtype="<u4")),
                                packed(np.concatenate(found))))
                else:
                    out.append((block, bucket, packed(np.array(found, dtype="<u4"))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                names=schema.names)
        known = {}
        trim()

    asked = block_rows.select("block_id", "words").mapInArrow(ask, "bucket int, block_id long, words binary")
    # the session's number of partitions, which Spark may coalesce, unless more are needed
    least = int(block_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.repartition(tasks, "bucket") if tasks > least else asked.repartition("bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(answer, schema)


def answered(block_rows: DataFrame, model: str, ids: bool) -> DataFrame:
    """Each block with ``word_buckets`` (packed, in its order of words) and the
    ``answers`` for its dictionary: an array of structs of ``bucket`` and the
    packed columns of ``segmented``, at most one per bucket."""
    buckets, tasks = spread(block_rows)

    @F.arrow_udf(T.BinaryType())
    def codes(words):
        import pyarrow as pa
        out = [packed(buckets_of(unpacked_words(w.as_py()) if w.is_valid else [], buckets)) for w in words]
        trim()
        return pa.array(out, pa.binary())

    answers = segmented(block_rows, model, ids, buckets, tasks)
    values = F.struct(*[c for c in answers.columns if c != "block_id"])
    per_block = answers.groupBy("block_id").agg(F.sort_array(F.collect_list(values)).alias("answers"))
    coded = block_rows.withColumn("word_buckets", codes.asNondeterministic()("words")).drop("words", "words_bytes")
    return coded.join(per_block, "block_id", "left")


def by_place(word_buckets: bytes, parts: list[bytes]):
    """Packed per-chunk numbers of each bucket, in bucket order -> one array
    in the block's order of words, and that order."""
    import numpy as np
    order = np.argsort(unpacked(word_buckets, "<u4"), kind="stable")
    out = np.zeros(len(order), dtype=np.int64)
    if len(order):
        out[order] = np.concatenate([unpacked(p, "<u4") for p in parts])
    return out, order
