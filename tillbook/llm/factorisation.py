"""Factorisation machine for document quality.

Features of a document: hashed words (lower-cased) and word shapes with
log counts scaled to unit length, structure statistics, and the declared
character count.  The score adds a linear term and low-rank pairwise
interactions ``sum_i<j <v_i, v_j> x_i x_j``, computed in linear time as
``0.5 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

Training reads a bounded sample of labelled rows (``max_train``, the rows
with the smallest hash of their id); scoring reads every row, in the task
that holds it, with the fixed-size model in the task's closure.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import column

WORD_DIM, SHAPE_DIM = 1 << 13, 1 << 9
N_STATS = 13
DIM = WORD_DIM + SHAPE_DIM + N_STATS
RANK = 8
CACHE_WORDS = 400_000
CUT = 0.3                  # score from which a document is predicted good


def shape(word: str) -> str:
    """Runs of A (upper), a (lower), 9 (digit); other characters stay, runs as one."""
    s = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", s)


class Features:
    """Sparse features of texts: (indices, values), statistics unscaled."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _code(self, word: str) -> int:
        w = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_DIM
        s = zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPE_DIM
        code = w * SHAPE_DIM + s
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = code
        return code

    def of(self, text: str | None, n_chars: int | None):
        import numpy as np
        text = text or ""
        words = text.split()
        n, known = len(words), self.known
        codes = np.array([known[w] if w in known else self._code(w) for w in words], dtype=np.int64)
        at, values = [], []
        for part, base in ((codes // SHAPE_DIM, 0), (codes % SHAPE_DIM, WORD_DIM)):
            i, c = np.unique(part, return_counts=True)
            x = np.log1p(c)
            at.append(i + base)
            values.append(x / max(1e-9, float(np.sqrt(x @ x))))
        return np.concatenate(at), np.concatenate(values), np.array(statistics(text, words, n, n_chars))


def statistics(text: str, words: list[str], n: int, n_chars: int | None) -> list[float]:
    from math import log1p
    size, some = max(1, len(text)), max(1, n)
    low = text.encode("utf-8", "surrogatepass")
    total = max(1, len(low))

    def share(chars: bytes) -> float:
        return (len(low) - len(low.translate(None, chars))) / total

    lines = [line for line in text.split("\n") if line.strip()]
    return [log1p(n), size / some, len(set(words)) / some, share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            share(b"0123456789"), share(b".,;:!?\"'()-"), share(b"#*$%&|<>"), share(b"!"),
            log1p(len(lines)), log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
            sum(map(eq, words, words[1:])) / some, log1p(n_chars if n_chars and n_chars > 0 else 0)]


class Model:
    """Weights and the scale of the statistics; ``raw`` is linear in the
    number of features."""

    def __init__(self, bias, linear, factors, mean, scale):
        self.bias, self.linear, self.factors, self.mean, self.scale = bias, linear, factors, mean, scale

    def row(self, at, values, stats):
        import numpy as np
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        return (np.concatenate([at, np.arange(DIM - N_STATS, DIM)]), np.concatenate([values, x]))

    def raw(self, at, values) -> float:
        v = self.factors[at]
        total = values @ v
        return float(self.bias + self.linear[at] @ values
                     + 0.5 * (total @ total - (values * values) @ (v * v).sum(axis=1)))

    def score(self, at, values, stats) -> float:
        from math import exp
        z = max(-30.0, min(30.0, self.raw(*self.row(at, values, stats))))
        return 1 / (1 + exp(-z))


def fit(rows: list[tuple], labels, epochs: int = 6, rate: float = 0.1, decay: float = 1e-5,
        batch: int = 64, seed: int = 3) -> Model:
    """Logistic loss by mini-batch AdaGrad.  ``rows``: (indices, values,
    statistics) per document.  Without rows, or with one label only, the
    model is the smoothed share of label 1 alone."""
    import numpy as np
    y = np.asarray(labels, dtype=np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    zero = Model(bias, np.zeros(DIM), np.zeros((DIM, RANK)), np.zeros(N_STATS), np.ones(N_STATS))
    if len(y) == 0 or y.min() == y.max():
        return zero
    stats = np.array([r[2] for r in rows])
    model = Model(bias, np.zeros(DIM), rng.normal(0, 0.05, (DIM, RANK)), stats.mean(axis=0),
                  np.maximum(stats.std(axis=0), 1e-6))
    data = [model.row(*r) for r in rows]
    g_bias, g_lin, g_fac = 1e-8, np.full(DIM, 1e-8), np.full((DIM, RANK), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            pick = order[lo:lo + batch]
            at = np.concatenate([data[i][0] for i in pick])
            x = np.concatenate([data[i][1] for i in pick])
            sizes = np.array([len(data[i][0]) for i in pick])
            owner = np.repeat(np.arange(len(pick)), sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = model.factors[at] * x[:, None]
            total = np.add.reduceat(vx, starts)
            z = (model.bias + np.add.reduceat(model.linear[at] * x, starts)
                 + 0.5 * ((total ** 2).sum(axis=1) - np.add.reduceat((vx ** 2).sum(axis=1), starts)))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            used, place = np.unique(at, return_inverse=True)
            lin = np.bincount(place, err[owner] * x, len(used)) + decay * model.linear[used]
            fac = np.zeros((len(used), RANK))
            np.add.at(fac, place, (err[owner] * x)[:, None] * (total[owner] - vx))
            fac += decay * model.factors[used]
            g_bias += err.sum() ** 2
            model.bias -= rate * err.sum() / g_bias ** 0.5
            g_lin[used] += lin ** 2
            model.linear[used] -= rate * lin / np.sqrt(g_lin[used])
            g_fac[used] += fac ** 2
            model.factors[used] -= rate * fac / np.sqrt(g_fac[used])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never trained on: CRC-32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000, id_col: str = "doc_id",
          text_col: str = "text", chars_col: str = "n_chars") -> Model:
    """Fit on at most ``max_train`` labelled, not held-out documents.

    Of several labels of an id the largest counts; null labels and ids do not.
    Of several documents of an id the one with the smallest hash of its text
    and character count is read, however the table is partitioned.  A null
    text counts as empty; without labelled documents every score is 0.5."""
    import numpy as np
    sample = (labels.select("doc_id", "quality").filter("quality is not null").filter(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"),
                       column(chars_col).cast("long").alias("n_chars"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("pick", T.LongType()),
                           T.StructField("quality", T.LongType()),
                           T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType()),
                           T.StructField("stats", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow, features = to_arrow_schema(schema), Features()
        for batch in batches:
            doc_ids, texts, chars, quality, pick = (batch.column(i) for i in range(5))
            made = [features.of(t.as_py(), c.as_py()) for t, c in zip(texts, chars)]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pick, quality, *[pa.array([m[i].astype(kind).tobytes() for m in made], pa.binary())
                                     for i, kind in enumerate(("<i2", "<f4", "<f4"))]], schema=arrow)

    # the sample is bounded by max_train ids
    found = (rows.join(F.broadcast(sample.withColumn("quality", F.col("quality").cast("long"))), "doc_id")
             .select("doc_id", "text", "n_chars", "quality", F.xxhash64("text", "n_chars").alias("pick"))
             .mapInArrow(run, schema).groupBy("doc_id")
             .agg(F.min_by(F.struct("quality", "at", "x", "stats"), "pick").alias("r"))
             .select("doc_id", "r.*").toArrow().sort_by("doc_id"))
    made = [tuple(np.frombuffer(found[c][i].as_py(), kind).astype(to) for c, kind, to in
                  (("at", "<i2", np.int64), ("x", "<f4", np.float64), ("stats", "<f4", np.float64)))
            for i in range(found.num_rows)]
    return fit(made, found["quality"].to_pylist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          chars_col: str = "n_chars") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from
    ``CUT`` on) of every row of ``docs``.

    The score depends on text and character count only.  A null text counts
    as empty and a null count as 0; a null id is held out; repeated rows get
    equal scores; an empty table gives no rows; other columns are ignored.
    """
    @F.arrow_udf(T.DoubleType())
    def scores(text, n_chars):
        import pyarrow as pa
        features = Features()
        return pa.array([model.score(*features.of(t.as_py(), c.as_py())) for t, c in zip(text, n_chars)], pa.float64())

    return (docs.select(column(id_col).alias("doc_id"), held_out(column(id_col)).alias("held_out"),
                        scores(column(text_col).cast("string"), column(chars_col).cast("long")).alias("score"))
            .withColumn("predicted", (F.col("score") >= CUT).cast("int")))
