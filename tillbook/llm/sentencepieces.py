"""SentencePiece encoding and decoding from a distinct-chunk table
(see ``chunk_table``): ids and decoded parts are joined back by position."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillbook.llm import chunk_table
from tillbook.llm.chunk_table import by_place, processors, unpacked, unpacked_places
from tillbook.llm.common import trim

OUT_BYTES = 8 << 20
DECODE_CHUNKS = 1 << 15


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit, with the
    begin and end ids) and ``decoded`` (the library's ``decode`` of them) of
    every row of ``docs``.

    A null or empty text is the begin and end ids alone and decodes to the
    empty text.  Null ids and repeated rows are kept as they are; an empty
    table gives no rows; other columns are ignored; a document is never cut.
    """
    block_rows = chunk_table.blocks(docs, id_col, text_col, frequencies=False)
    joined = chunk_table.answered(block_rows, model, ids=True).select(
        "doc_ids", "n_places", "places", "word_buckets", "answers")
    schema = T.StructType([
        T.StructField("doc_id", block_rows.schema["doc_ids"].dataType.elementType),
        T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        full, bare = processors(model)
        begin, end = (struct.pack("<I", i) for i in (full.bos_id(), full.eos_id()))

        def batch_of(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

        def table(word_buckets, answers):
            """Ids (binary) and decoded text by place."""
            sizes, order = by_place(word_buckets, [a["sizes"] for a in answers])
            ids, text = [b""] * len(order), [""] * len(order)
            if not len(order):
                return ids, text
            flat = np.concatenate([unpacked(a["ids"], "<u4") for a in answers])
            ends = np.cumsum(sizes[order])
            for lo in range(0, len(order), DECODE_CHUNKS):
                at, stops = order[lo:lo + DECODE_CHUNKS].tolist(), ends[lo:lo + DECODE_CHUNKS].tolist()
                start = int(ends[lo - 1]) if lo else 0
                part = flat[start:stops[-1]]
                data, numbers = part.tobytes(), part.tolist()
                cuts = [0, *[s - start for s in stops]]
                decoded = bare.decode([numbers[a:b] for a, b in zip(cuts, cuts[1:])], num_threads=1)
                for p, a, b, d in zip(at, cuts, cuts[1:], decoded):
                    ids[p], text[p] = data[4 * a:4 * b], d
            return ids, text

        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids = batch.column(0)[i].as_py()
                ends = np.cumsum(batch.column(1)[i].values.to_numpy()).tolist()
                places = unpacked_places(batch.column(2)[i].as_py())
                ids, text = table(batch.column(3)[i].as_py(), batch.column(4)[i].as_py() or [])
                out, size, start = [], 0, 0
                for doc_id, stop in zip(doc_ids, ends):
                    at = places[start:stop].tolist()
                    start = stop
                    decoded = "".join([text[p] for p in at])
                    out.append((doc_id, b"".join([begin, *[ids[p] for p in at], end]),
                                decoded[1:] if decoded.startswith(" ") else decoded))
                    size += 4 * len(at) + len(decoded)
                    if size > OUT_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
                if out:
                    yield batch_of(out)
                ids = text = out = None
                trim()

    return joined.mapInArrow(run, schema)
