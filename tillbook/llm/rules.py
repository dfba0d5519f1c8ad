"""Quality rules whose cutoffs carry a risk guarantee.

Each rule measures one kind of junk as a share (higher is worse), kept as an
integer: thousandths, rounded up.  Labelled documents are split in two by a
hash of their id.

* One half lays the grid: level by level, from lenient to strict, a rule's
  cutoff is the least one that at most a share ``STEPS[level]`` of the good
  documents exceeds.  Its shares are counted by value (at most 1001 a rule),
  so the grid is exact and the same at any partitioning.
* The other half, the holdout, certifies: in every stratum the share of its
  good documents that a level would reject is a binomial proportion, and its
  exact (Clopper-Pearson) upper bound must not exceed ``risk`` for the level
  to be used.  The grid ends far beyond the risk, so the bound stops it.

Multiple testing: the strata share the error probability ``delta`` equally
(Bonferroni); within a stratum the levels are tested from lenient to strict
and testing stops at the first failure, which needs no further correction
(fixed-sequence testing; the sequence is fixed by the other half).  So with
probability ``1 - delta`` at least, in no stratum more than a share ``risk``
of good documents is falsely rejected by any level that passes.  Of these the
most lenient is used that rejects as many bad documents of the holdout as the
strictest.  A stratum with too few labels gets no cutoffs.

The guarantee covers what the cutoffs reject among documents that pass the
base rules (fixed limits on words and repeats, not learnt).  Good documents
that fail the base rules are rejected beside it, and do not count in either
half.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import bound_batches, column, stored, trim

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
RULES = ("symbols", "dup_lines", "repeats", "shouting", "long_words")
# Per level, the share of the grid's good documents that may exceed a cutoff
STEPS = (0.0, 0.001, 0.0025, 0.005, 0.01, 0.02, 0.04, 0.08)
LONG_WORD = 40             # bytes

_STATS = T.StructType([T.StructField(c, T.LongType()) for c in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_long_words")])


def text_stats(text: str | None) -> tuple[int, ...]:
    """The fields of a document's statistics, in order.

    Words are runs without ASCII white space; ``n_lines`` counts lines with a
    word, ``n_letters`` and ``n_upper`` ASCII letters.
    """
    if not text:
        return (0,) * len(_STATS)
    data = text.encode("utf-8")
    words = data.split()
    n = len(words)
    lines, seen, dup = 0, set(), 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\v\f\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        first, covered = {}, bytearray(n)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                covered[i:i + 3] = covered[j:j + 3] = b"\1\1\1"
        repeat = sum(covered)
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (n, len(text) - sum(map(data.count, SPACE.encode())),
            len(data) - len(data.translate(None, SYMBOLS.encode())), dup, repeat,
            lines, upper + lower, upper, sum(len(w) > LONG_WORD for w in words))


@F.arrow_udf(_STATS)
def stats(text):
    import pyarrow as pa
    rows = [text_stats(t.as_py()) for t in text]
    trim()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else
                                      [pa.array([], pa.int64())] * len(_STATS), names=_STATS.names)


# never evaluated again in a filter pushed below its projection
stats = stats.asNondeterministic()


def _shares() -> Column:
    """The shares of the statistics ``s`` in thousandths, rounded up (0 to
    1000), in the order of RULES."""
    pairs = [("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"),
             ("n_upper", "n_letters"), ("n_long_words", "n_words")]
    return F.array(*[F.expr(f"(1000 * s.{part} + greatest(s.{whole}, 1) - 1) div greatest(s.{whole}, 1)")
                     for part, whole in pairs])


def _first_level(grid: list[list[int]]) -> Column:
    """The first level (from 1) that rejects ``shares``; one past the last if
    none does."""
    out = F.lit(len(grid) + 1)
    for level in range(len(grid), 0, -1):
        hit = F.lit(False)
        for i, cut in enumerate(grid[level - 1]):
            hit = hit | (F.col("shares")[i] > cut)
        out = F.when(hit, level).otherwise(out)
    return out


def lay_grid(counts: list[dict[int, int]]) -> list[list[int]]:
    """Cutoffs per level and rule from the number of good documents per share
    (thousandths) of each rule; no levels without documents."""
    if not all(counts):
        return []
    grid = []
    for step in STEPS:
        cuts = []
        for by in counts:
            spare = int(step * sum(by.values()) + 1e-9)
            for cut in sorted(by, reverse=True):
                if by[cut] > spare:             # a cutoff below would reject these as well
                    break
                spare -= by[cut]
            cuts.append(cut)
        grid.append(cuts)
    return grid


def _base_failed() -> Column:
    return ((F.col("s.n_words") < MIN_WORDS)
            | (100 * F.col("s.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("s.n_words")))


def upper_bound(failures: int, n: int, error: float) -> float:
    """Exact upper confidence bound of a binomial proportion: the largest p
    with P(X <= failures | n, p) >= error, by bisection."""
    if failures >= n:
        return 1.0

    def tail(p: float) -> float:             # P(X <= failures), summed in logs
        base = math.lgamma(n + 1)
        return sum(math.exp(base - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                            + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(failures + 1))

    lo, hi = failures / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid in (0.0, 1.0):
            break
        lo, hi = (mid, hi) if tail(mid) >= error else (lo, mid)
    return hi


def select_level(n: int, rejected: list[int], risk: float, error: float) -> int:
    """The last level of the longest run from level 1 on whose bound holds;
    0 if even level 1 fails.  ``rejected`` counts per level."""
    level = 0
    for failures in rejected:
        # beyond the risk itself no bound can hold; saves summing large tails
        if failures > risk * n or upper_bound(failures, n, error) > risk:
            break
        level += 1
    return level


def useful_level(level: int, bad: list[int]) -> int:
    """The most lenient level, up to ``level``, that rejects as many labelled
    bad documents (``bad`` counts per level) as ``level`` does."""
    most = bad[level - 1] if level else 0
    return next((k for k, n in enumerate(bad[:level], 1) if n == most and n), 0)


def _lays_grid(id_col: Column) -> Column:
    """Whether a labelled document is of the half that lays the grid."""
    return F.xxhash64(id_col.cast("string")) % 2 == 0


def _chosen(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> tuple[list[list[int]], DataFrame]:
    """The grid, and ``stratum``, ``certified``, ``level`` for the strata with
    documents in the holdout.

    ``measured``: ``doc_id``, ``stratum``, ``base_failed``, ``shares``."""
    labelled = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality in (0, 1)")
    every = range(len(RULES))
    held = stored(measured.filter("not base_failed").select("doc_id", "stratum", "shares").join(labelled, "doc_id")
                  .groupBy("doc_id", "stratum", "quality")
                  .agg(F.array(*[F.max(F.col("shares")[i]) for i in every]).alias("shares")), "rule-labelled")
    by: list[dict[int, int]] = [{} for _ in every]
    laying = held.filter(_lays_grid(F.col("doc_id")) & (F.col("quality") == 1))
    # at most 1001 rows a rule
    for rule, share, n in laying.select(F.posexplode("shares")).groupBy("pos", "col").count().collect():
        by[rule][share] = n
    grid = lay_grid(by)
    held = held.filter(~_lays_grid(F.col("doc_id"))).withColumn("first_level", _first_level(grid))

    def rejected(quality: int):
        hit = [(F.col("quality") == quality) & (F.col("first_level") <= k) for k in range(1, len(grid) + 1)]
        return F.array(*[F.count(F.when(h, 1)) for h in hit]).cast("array<long>")

    counts = stored(held.groupBy("stratum").agg(
        F.count(F.when(F.col("quality") == 1, 1)).alias("n"), rejected(1).alias("good"), rejected(0).alias("bad")),
        "rule-counts")
    error = delta / max(1, counts.count())

    @F.arrow_udf(T.IntegerType())
    def certified(n, good):
        import pyarrow as pa
        return pa.array([select_level(a.as_py(), g.as_py(), risk, error) for a, g in zip(n, good)], pa.int32())

    @F.arrow_udf(T.IntegerType())
    def level(strictest, bad):
        import pyarrow as pa
        return pa.array([useful_level(k.as_py(), b.as_py()) for k, b in zip(strictest, bad)], pa.int32())

    return grid, (counts.select("stratum", "bad", certified("n", "good").alias("certified"))
                  .select("stratum", "certified", level("certified", "bad").alias("level")))


def _measure(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    return (docs.select(column(id_col).alias("doc_id"),
                        F.coalesce(column(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                        stats(column(text_col).cast("string")).alias("s"))
            .select("doc_id", "stratum", "s", _base_failed().alias("base_failed"), _shares().alias("shares")))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05,
          id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Statistics and verdict of every row of ``docs``.

    ``doc_id``, the statistics, ``base_failed``, ``stratum``, ``certified``
    (the strictest level the bound allows the stratum; 0: none), ``level``
    (the one used; 0: none) and ``kept``.  ``labels`` holds ``doc_id`` and
    ``quality`` (1 good, 0 bad); of several labels the best counts, others and
    nulls do not.  A null stratum is the stratum "".  A null text has no words and
    fails the base rules; a null id is judged like any other; repeated rows
    are all judged, and count once per id and stratum, each rule by its
    highest share; empty
    tables give no rows or no cutoffs; other columns are ignored.
    """
    measured = stored(_measure(docs, id_col, text_col, stratum_col), "rule-stats")
    grid, levels = _chosen(measured, labels.select("doc_id", "quality"), risk, delta)
    level = F.coalesce("level", F.lit(0))
    return (measured.join(levels, "stratum", "left")
            .select("doc_id", "s.*", "base_failed", "stratum",
                    F.coalesce("certified", F.lit(0)).alias("certified"), level.alias("level"),
                    (~F.col("base_failed") & (_first_level(grid) > level)).alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05,
              id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps.

    Two passes measure the rows where they are read; only statistics are
    shuffled (to their labels), never texts."""
    grid, levels = _chosen(_measure(docs, id_col, text_col, stratum_col), labels.select("doc_id", "quality"), risk, delta)
    levels = stored(levels.select("stratum", "level"), "rule-levels")
    names = docs.columns
    rows = docs.select(*[column(c).alias(f"d_{c}") for c in names],
                       F.coalesce(column(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                       stats(column(text_col).cast("string")).alias("s"))
    return (rows.filter(~_base_failed()).withColumn("shares", _shares()).join(levels, "stratum", "left")
            .filter(_first_level(grid) > F.coalesce("level", F.lit(0)))
            .select(*[column(f"d_{c}").alias(c) for c in names]))
