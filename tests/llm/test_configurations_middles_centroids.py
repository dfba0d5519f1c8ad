"""Operators 11 to 13 against brute force, the tokenizer library and exact
round trips."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from tillbook.llm import centroids, configuration_packing, fill_middle, queries

ODD = [None, "", " ", "\n\t ", "x", "é", " naïve  café  ok ", "日本 語\U0001F600 \U0001F600z\n",
       "one <|endoftext|> two", "has <S> inside", "<P", "a\x85b \x1c c", " " * 12_000 + "end", "wörd " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    """Driver rows, odd rows, a repeated row, and columns of clashing names."""
    real = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    odd = [(9_000_000 + i, t) for i, t in enumerate(ODD)] + [(9_000_000, None), (9_000_004, "x"),
                                                                     (None, "no id here"), (None, None)]
    return (real.union(spark.createDataFrame(odd, "doc_id long, text string"))
            .withColumn("n", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("length", F.lit(None))
            .repartition(3))


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# -- 11 ------------------------------------------------------------------------

@pytest.mark.parametrize("small", [0, configuration_packing.SMALL])
def test_configuration_packing(docs, plain, small, monkeypatch):
    monkeypatch.setattr(configuration_packing, "SMALL", small)
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    want = Counter()
    for doc_id, text in plain:
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        at, n = 0, len(ids) % 1024 or min(len(ids), 1024)
        k = 0
        while at < len(ids):
            want[doc_id, k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()), len(ids)] += 1
            at, n, k = at + n, 1024, k + 1
    rows = configuration_packing.pack(docs, queries.BYTE_TOKENIZER).collect()
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1]
        assert sum(n for _, n in places) <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= 1 + 1.02 * math.ceil(sum(r.length for r in rows) / 1024)


def test_a_second_run_of_a_task_takes_the_same_places(docs):
    stored = configuration_packing.pieces(docs, queries.BYTE_TOKENIZER, 1024, 2, "doc_id", "text")
    keys = [(r.part, r.length, r.nth) for r in stored.select("part", "length", "nth").collect()]
    assert len(set(keys)) == len(keys)
    assert all(sorted(n for p, l, n in keys if (p, l) == k) == list(range(c))
               for k, c in Counter((p, l) for p, l, _ in keys).items())


def least_bins(items, capacity):
    """The optimum by search, for a dozen items."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            j = rooms.index(room)
            place(i + 1, rooms[:j] + [room - items[i]] + rooms[j + 1:])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_plans_hold_every_piece_once_in_few_sequences():
    rng = random.Random(11)
    for trial in range(60):
        capacity = rng.choice([10, 17, 64])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        counts = dict(Counter(items))
        plan = configuration_packing.plan(counts, capacity)
        ranks, fills = defaultdict(list), defaultdict(list)
        for length, rank, n, sequence, offset in plan.slots:
            ranks[length] += range(rank, rank + n)
            for i in range(n):
                fills[sequence + i].append((offset, length))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
        assert len(fills) == plan.sequences
        for places in fills.values():
            places.sort()
            assert [o for o, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1]
            assert sum(n for _, n in places) <= capacity
        least = least_bins(items, capacity)
        assert plan.bound <= least <= plan.sequences <= least + 1


def test_the_program_comes_close_to_its_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(5.6, 0.9, 40_000).astype(int) + 1, 1024)
    plan = configuration_packing.plan({int(n): int(k) for n, k in zip(*np.unique(lengths, return_counts=True))}, 1024)
    assert plan.sequences <= 1.002 * plan.bound


def test_knapsack_is_the_best_filling():
    rng = np.random.default_rng(5)
    for _ in range(20):
        value = np.full(13, -np.inf)
        at = rng.choice(np.arange(1, 13), 4, replace=False)
        value[at] = rng.random(4)
        best, last = configuration_packing.knapsack(value, 12)
        slow = [0.0] * 13
        for c in range(1, 13):
            slow[c] = max([slow[c - 1]] + [slow[c - n] + value[n] for n in at if n <= c])
        assert np.allclose(best, slow)
        filling = configuration_packing.traced(last, 12)
        assert sum(filling) <= 12 and np.isclose(sum(value[n] for n in filling), best[12])


def test_ranks_equal_the_library():
    encoder = configuration_packing.Encoder(queries.BYTE_TOKENIZER)
    assert encoder.fast is not None
    rng = random.Random(2)
    alphabet = "ab  \n\t'sé 日\U0001F600!?12<|>\x00\x85 "
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(2000)]
    texts += [" " * 9_999 + "a", "b" + "\n" * 30_000, "z" * 20_000 + " <|endoftext|>", "".join(map(chr, range(1, 3000)))]
    for text in texts:
        ids = encoder.whole.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes()
    # a file of another kind is left to the library
    other = configuration_packing.Encoder(queries.WORD_TOKENIZER)
    assert other.fast is None
    assert other.encode("Some words.") == np.array(
        other.whole.encode("Some words.", add_special_tokens=False).ids, "<u4").tobytes()


# -- 12 ------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_middle(doc_id, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(docs, plain):
    made = fill_middle.transform(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    rows = made.collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.back))
                   for r in rows) == Counter((d, *slow_middle(d, t)[:4], sha(slow_middle(d, t)[4]), sha(t))
                                             for d, t in plain)
    assert {r.form for r in rows} == {"plain", "spm", "psm"}


def test_fill_middle_of_random_texts(spark):
    rng = random.Random(12)
    alphabet = "ab \n\t\r\x0b\x0cé日\U0001F600<PSM> \x00"
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 30)))) for i in range(3000)]
    made = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string")).withColumn(
        "back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made}
    assert got == {i: slow_middle(i, t) for i, t in rows}
    assert {r.doc_id: r.back for r in made} == dict(rows)


def test_exception_index_converts_both_ways():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("ab é߿ࠀ日￿\U00010000\U0010ffff", k=rng.randint(0, 60)))
        index = fill_middle.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
        points = np.arange(len(text) + 1)
        cut = np.array([len(text[:i].encode()) for i in points])
        assert (index.to_points(cut) == points).all() and (index.to_bytes(points) == cut).all()
    assert len(fill_middle.ExceptionIndex(np.frombuffer(b"only ascii" * 99, np.uint8)).at) == 0


# -- 13 ------------------------------------------------------------------------

def slow_clusters(rows, k, rounds, dims, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept)
    now = [q for _, q in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(now)) for _, q in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(now)):
            own = [q for (_, q), (_, c) in zip(kept, at) if c == j]
            if own:
                now[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    total = Counter()
    for d, j in at:
        total[j] += d
    return Counter((i, j, d, total[j], sum(total.values()), tuple(now[j])) for (i, _), (d, j) in zip(kept, at))


def as_counter(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid))
                   for r in df.collect())


@pytest.mark.parametrize("k,rounds", [(7, 5), (40, 2), (500, 1)])
def test_clusters(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [round(rng.gauss(i % 5, 0.7), 1) for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [0.5, -0.5, 0.0, 0.25]) for i in range(150)]                  # one very common vector
    rows += [(7, rows[7][1]), (900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0, 3.0]),
             (904, [float("nan"), 0.0, 0.0, 0.0]), (905, [0.0, float("-inf"), 0.0, 0.0]), (906, [0.0] * 5),
             (907, [1e-9, -1e-9, 1000.0, -1000.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn(
        "cluster", F.lit("clash")).withColumn("q", F.lit(0)).repartition(3)
    assert as_counter(centroids.cluster(table, k, rounds, dims=4, pivots=3)) == slow_clusters(rows, k, rounds, 4)


def test_clusters_of_the_driver_table(spark):
    table = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert as_counter(centroids.cluster(table)) == slow_clusters(rows, 40, 5, 64)


def test_bounds_spare_distances_and_lose_none():
    rng = np.random.default_rng(0)
    at = rng.normal(size=(20, 8)) * 400
    x = np.floor(at[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8)) * 20).astype(np.int64)
    c = np.concatenate([x[:20], x[:3]])                           # equal centroids: ties
    p = np.array(centroids.chosen_pivots(c.tolist(), 6))
    to_p, c_to_p = (np.sqrt(((v[:, None, :] - p) ** 2).sum(axis=2).astype(float)) for v in (x, c))
    best, distance, exact = centroids.nearest(x, to_p, c, c_to_p)
    full = ((x[:, None, :] - c) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert exact < 0.4 * full.size


def test_a_component_beyond_the_range_is_an_error(spark):
    table = spark.createDataFrame([(1, [0.0, 2.0 ** 21])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="component"):
        centroids.cluster(table, dims=2).collect()


def test_new_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert configuration_packing.pack(none, queries.BYTE_TOKENIZER).collect() == []
    assert fill_middle.transform(none).collect() == []
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
