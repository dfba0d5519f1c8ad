"""Fill-in-the-middle transformation with a sparse exception index.

A text is cut between its tokens (white space and the word after it).  The
cuts are needed in bytes, to take the parts out of the UTF-8 text, and in code
points, which is what a caller counts.  Where a text is ASCII the two are the
same number; so only the multibyte characters are recorded, by position and by
the bytes they have beyond one.  ``searchsorted`` finds how many of them lie
before a cut, their running excess turns one kind of cut into the other, and
the ASCII spans between them cost nothing.

Where the cuts fall and which form a document takes follow from a hash of its
id, so a task that is run again gives the same rows; no row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import id_text, sliced, trim

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = b"\t\n\v\f\r "
SLICE_BYTES = 4 << 20      # of text whose tokens are found at once


class ExceptionIndex:
    """Cuts of one UTF-8 text: ``to_points`` (bytes to code points) and
    ``to_bytes``.  Cuts must not fall within a character."""

    def __init__(self, data):
        """``data``: the text's bytes, a numpy array of unsigned bytes."""
        import numpy as np
        self.at = np.flatnonzero(data >= 0xC0)             # first bytes of multibyte characters
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])
        self.points = self.at - self.before[:-1]           # the same places in code points

    def to_points(self, cut):
        import numpy as np
        return cut - self.before[np.searchsorted(self.at, cut, side="left")]

    def to_bytes(self, cut):
        import numpy as np
        return cut + self.before[np.searchsorted(self.points, cut, side="left")]


def token_ends(data):
    """Byte ends of the tokens of one text, an array of unsigned bytes: a
    word with the white space before it, or white space at the end.  Only
    the six ASCII characters of ``SPACE`` are white space."""
    import numpy as np
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(SPACE, np.uint8)] = True
    space = table[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(data)) if len(data) else ends


def draws(id_col: Column, seed: int, n: int = 4) -> list[Column]:
    """``n`` numbers below 2 to the 32nd from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as it is, or with a middle part moved to its end.

    Columns: ``doc_id``, ``n`` (tokens), ``form``, ``prefix_chars`` and
    ``middle_chars`` (code points), ``prefix_bytes`` and ``middle_bytes``, and
    ``output``:

    * ``plain`` (the four lengths are null): the text.  All documents but
      ``rate`` of a hundred, and those that are empty or hold a marker;
    * ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``spm_rate`` of a
      hundred of the others;
    * ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, the rest.

    The prefix ends after the smaller of two drawn numbers of tokens, from
    none to all, the middle after the larger; parts can be empty.  A null text
    counts as empty, a null id draws from the empty text; repeated rows give
    equal rows; an empty table gives no rows; other columns are ignored.
    """
    rows = id_text(docs, id_col, text_col)
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)])
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()), T.StructField("prefix_bytes", T.LongType()),
        T.StructField("middle_bytes", T.LongType()), T.StructField("output", T.StringType())])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def one(raw: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
        import numpy as np
        data = np.frombuffer(raw, np.uint8)
        ends = token_ends(data)
        n = len(ends)
        if not raw or h3 % 100 >= rate or any(m in raw for m in marks):
            return n, "plain", None, None, None, None, raw
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        cut = np.concatenate([[0], ends])[[a, b]]
        points = ExceptionIndex(data).to_points(cut)
        p, m, s = raw[:cut[0]], raw[cut[0]:cut[1]], raw[cut[1]:]
        form = "spm" if h4 % 100 < spm_rate else "psm"
        out = marks[1] + s + marks[0] + p if form == "spm" else marks[0] + p + marks[1] + s
        return (n, form, int(points[0]), int(points[1] - points[0]), len(p), len(m), out + marks[2] + m)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in batches:
            lo = 0
            for texts in sliced(batch.column(1), SLICE_BYTES):
                part = batch.slice(lo, len(texts))
                lo += len(texts)
                raw = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
                made = [one(t.as_buffer().to_pybytes(), *h)
                        for t, h in zip(raw, zip(*(part.column(c).to_pylist() for c in range(2, 6))))]
                columns = [pa.array(c, f.type) for c, f in zip(list(zip(*made))[:-1], list(arrow)[1:-1])]
                output = pa.array([m[-1] for m in made], pa.binary()).cast(arrow[len(arrow) - 1].type)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, output], schema=arrow)
        trim()

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` had.  A marker cannot arise where parts
    meet, as each part is free of them and they differ after their first
    character; so the markers found are the ones set."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
