"""N-gram Jaccard self-join of documents by MinHash banding.

1. Texts with the same n-gram set form one node (key: 128 bits over the
   sorted n-gram hashes); copies are counted, never paired.
2. ``banding`` chooses rows per band and the number of bands for a target
   recall at the threshold.  Each node sends one row per band, keyed by the
   band's hash.  Within a band hash every node is tied to the smallest node
   only (a grouped minimum), so a group of m nodes makes m rows, not m^2.
3. Connected components of these ties are the *cells*: every two nodes that
   share any band are in one cell.  Cells only say who must be compared.
4. Cells are cut into blocks of ``block_nodes`` nodes and every two blocks
   of a cell meet in one group, where the full n-gram sets of their nodes
   are intersected by a matrix product.  A group's size is bounded however
   large the cell is, all pairs of a cell are verified, and no pair becomes
   a row: a group returns each node's number of links and a spanning forest
   of the verified links.
5. Connected components of the forests are the classes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import bound_batches, column, id_text, sliced, stored, trim
from tillbook.llm.components import connected_components

BLOCK_NODES = 192         # expected nodes, and n-grams, of a block at most
BLOCK_GRAMS = 1 << 20
MAX_HASHES = 512
SLICE_BYTES = 2 << 20      # of text whose words are numbered at once
SLICE = 512                # n-grams hashed against all permutations at once
COLUMNS = 4096             # n-grams per dense slice of the matrix product


def banding(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows per band whose number of bands
    for the target recall at ``threshold`` stays within ``max_hashes``."""
    best = None
    for rows in range(1, 33):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall within max_hashes")
    return best


def ngram_hashes(texts, n: int):
    """Per text of an Arrow string array, the sorted distinct 64-bit hashes of
    its word n-grams.

    Words are runs without white space, compared lower-cased.  A text with
    words but fewer than ``n`` has one n-gram, all its words; a text without
    words has none.  Texts are taken some megabytes at a time; words are
    split and numbered by Arrow and each distinct one hashed once.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    def step(h, word):
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def last(h):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    digest = xxhash.xxh3_64_intdigest
    for part in sliced(texts, SLICE_BYTES):
        split = pc.utf8_split_whitespace(pc.fill_null(part, ""))
        words, ends = split.flatten(), split.offsets.to_numpy()
        ends = ends - ends[0]
        there = pc.binary_length(words).to_numpy() > 0      # a text's ends may split off empty words
        counts = np.concatenate([[0], np.cumsum(there)])[ends]
        coded = words.filter(pa.array(there)).dictionary_encode()
        of = np.fromiter((digest(w.lower().encode("utf-8")) for w in coded.dictionary.to_numpy(zero_copy_only=False)),
                         dtype=np.uint64, count=len(coded.dictionary))
        h = of[coded.indices.to_numpy()] if len(of) else np.empty(0, dtype=np.uint64)
        grams = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)
        for i in range(n):                                  # windows over the ends of texts are not used
            grams = step(grams, h[i:i + len(grams)])
        grams = last(grams)
        for a, b in zip(counts.tolist(), counts[1:].tolist()):
            if b - a >= n:
                own = np.sort(grams[a:b - n + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b == a:
                yield h[:0]
            else:
                one = np.full(1, b - a, dtype=np.uint64)
                for i in range(a, b):
                    one = step(one, h[i:i + 1])
                yield last(one)


def set_key(hashes) -> bytes:
    """128-bit key of an n-gram set."""
    import xxhash
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


class Signer:
    """One 64-bit hash per band and n-gram set, the band's number mixed in.

    The permutations multiply 32 bits of the n-gram hash by odd numbers."""

    def __init__(self, bands: int, rows: int):
        import numpy as np
        rng = np.random.Generator(np.random.PCG64(7))
        self.bands, self.rows = bands, rows
        self.odd = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.space = np.empty((SLICE, bands * rows), dtype=np.uint32)

    def __call__(self, hashes):
        import numpy as np
        x = (hashes >> np.uint64(32)).astype(np.uint32) ^ (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), SLICE):
            part = x[at:at + SLICE, None]
            made = np.multiply(part, self.odd, out=self.space[:len(part)])
            np.minimum(low, made.min(axis=0), out=low)
        low = low.reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(self.rows):
            out = (out ^ low[:, i]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)


def _key_udf(n: int):
    @F.arrow_udf(T.BinaryType())
    def keys(text):
        import pyarrow as pa
        out = pa.array([set_key(h) if len(h) else None for h in ngram_hashes(text, n)], pa.binary())
        trim()
        return out
    return keys.asNondeterministic()        # not evaluated again in filters pushed down


def _signed(rows: DataFrame, n: int, bands: int, rows_per_band: int) -> DataFrame:
    """Per row of ``rows`` (``doc_id``, ``text``): ``doc_id``, ``node`` (null
    without words), ``n_grams``, and ``bands`` (array) at the node's first
    row in the task, null at its later copies."""
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType),
                           T.StructField("node", T.BinaryType()), T.StructField("n_grams", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        seen: set[bytes] = set()
        sign = Signer(bands, rows_per_band)
        for batch in batches:
            out = []
            for doc_id, h in zip(batch.column(0).to_pylist(), ngram_hashes(batch.column(1), n)):
                key = set_key(h) if len(h) else None
                signed = None
                if key is not None and key not in seen:
                    seen.add(key)
                    signed = sign(h)
                out.append((doc_id, key, len(h), signed))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        trim()

    return rows.mapInArrow(run, schema)


def _verify(threshold: float):
    """Group function: one pair of blocks of a cell -> links and forest.

    Rows: ``side`` (0 and 1, or 2 where a block meets itself), ``node``,
    ``copies``, ``grams``.  Returns per linked node the number of rows it
    links to in the group, and ``up``, its root in a spanning forest of the
    group's links (null for the roots themselves).
    """
    def run(table):
        import numpy as np
        import pyarrow as pa
        side = table["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        nodes = [table["node"][int(i)].as_py() for i in order]
        copies = table["copies"].to_numpy()[order]
        grams = [np.frombuffer(table["grams"][int(i)].as_py(), dtype="<u8") for i in order]
        n = len(nodes)
        itself = side[0] == 2
        left = n if itself else int((side == 0).sum())
        r0 = 0 if itself else left
        size = np.array([len(g) for g in grams])
        owner = np.repeat(np.arange(n), size)
        _, gram, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        shared = times > 1                     # a gram of one node alone joins nothing
        number = np.cumsum(shared) - 1
        keep = shared[gram]
        owner, gram = owner[keep], number[gram[keep]]
        by = np.argsort(gram, kind="stable")
        owner, gram = owner[by], gram[by]
        both = np.zeros((left, n - r0), dtype=np.float64)
        for lo in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(gram, [lo, lo + COLUMNS])
            m = np.zeros((n, COLUMNS), dtype=np.float32)
            m[owner[a:b], gram[a:b] - lo] = 1
            both += m[:left] @ m[r0:].T
        union = size[:left, None] + size[None, r0:] - both
        # both / union >= threshold, without rounding at the threshold itself
        link = both * 1_000_000 >= round(threshold * 1_000_000) * union
        if itself:
            np.fill_diagonal(link, False)
        links = np.zeros(n, dtype=np.int64)
        links[:left] += link @ copies[r0:]
        if not itself:
            links[r0:] += copies[:left] @ link
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        up: list[bytes | None] = [None] * n
        for i, j in zip(*np.nonzero(link)):
            a, b = root(int(i)), root(int(j) + r0)
            if a != b:
                parent[b] = a
        for i in range(n):
            if root(i) != i:
                up[i] = nodes[root(i)]
        pick = np.nonzero(links)[0].tolist()
        return pa.table({"node": pa.array([nodes[i] for i in pick], pa.binary()),
                         "links": pa.array(links[pick], pa.int64()),
                         "up": pa.array([up[i] for i in pick], pa.binary())})
    return run


def _classes(docs: DataFrame, threshold: float, recall: float, n: int) -> tuple[DataFrame, DataFrame]:
    """``members``: ``doc_id``, ``node`` per row; ``nodes``: ``node``,
    ``copies``, ``links`` (rows linked to other nodes), ``component``."""
    bound_batches(docs.sparkSession)
    made = stored(_signed(docs, n, *banding(threshold, recall)), "ngram-bands")
    members = made.select("doc_id", "node")
    nodes = (made.filter("node is not null").groupBy("node")
             .agg(F.count(F.lit(1)).alias("copies"), F.max("n_grams").alias("n_grams")))
    # ties to the smallest node of each band hash
    keyed = made.filter("bands is not null").select("node", F.explode("bands").alias("band"))
    least = keyed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    ties = (keyed.join(least.filter("low < high"), "band").filter("node != low")
            .select(F.col("node").alias("a"), F.col("low").alias("b")))
    cells = connected_components(ties).join(nodes, "node")
    shape = cells.groupBy("component").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = (_with_grams(docs, cells.join(shape, "component"), n)
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                      F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0)
                      .otherwise(1).alias("side"), "node", "copies", "grams"))
    out = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("links", T.LongType()),
                        T.StructField("up", T.BinaryType())])
    found = stored(placed.groupBy("component", "one", "two").applyInArrow(_verify(threshold), out), "ngram-links")
    classes = connected_components(found.filter("up is not null")
                                   .select(F.col("node").alias("a"), F.col("up").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    return members, (nodes.join(links, "node", "left").join(classes, "node", "left").select(
        "node", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.coalesce("component", "node").alias("component")))


def _with_grams(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``nodes`` with their full n-gram sets.  Texts, not sets, are shuffled
    to their node, as they are smaller; a node's copies collapse per task."""
    texts = (docs.select(_key_udf(n)("text").alias("node"), "text").filter("node is not null")
             .dropDuplicates(["node"]).join(nodes, "node"))
    schema = T.StructType([*nodes.schema.fields, T.StructField("grams", T.BinaryType())])
    names = nodes.columns

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                grams = pa.array([h.astype("<u8").tobytes() for h in ngram_hashes(part.column(len(names)), n)],
                                 pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], grams], names=schema.names)
        trim()

    return texts.select(*names, "text").mapInArrow(run, schema)


def jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, n: int = 5,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents linked by Jaccard similarity of word n-gram sets.

    One row per row of ``docs``: ``doc_id``, ``class_id`` (smallest id of the
    connected component of links it is in), ``n_links`` (other rows whose set
    has a similarity of ``threshold`` or more to its own, copies included)
    and ``class_size`` (rows of the component).

    A text without words (null, empty, white space) links to nothing and is
    a class of its own; texts shorter than ``n`` words have one n-gram.
    Rows with the same set link to each other, also when the id repeats.  A
    class of null ids only has a null ``class_id``.  An empty table gives no
    rows; other columns are ignored.
    """
    members, nodes = _classes(id_text(docs, id_col, text_col), threshold, recall, n)
    # ids per node first: copies collapse before anything is joined per class
    ids = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    known = nodes.join(ids, "node")
    per_class = known.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    known = known.join(per_class, "component").select(
        "node", "class_id", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return (members.filter("node is not null").join(known, "node").select("doc_id", "class_id", "n_links", "class_size")
            .union(members.filter("node is null").select(
                "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long"), F.lit(1).cast("long"))))


def keep_one_per_class(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, n: int = 5,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each class:
    the one with the smallest id (of equal ids, any one).  Rows without words
    all stay."""
    members, nodes = _classes(id_text(docs, id_col, text_col), threshold, recall, n)
    best = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    stay = (nodes.join(best, "node").groupBy("component")
            .agg(F.min(F.struct(F.col("least").isNull(), F.col("least"), F.col("node"))).alias("m"))
            .select(F.col("m.node").alias("k_node")))
    row = F.struct(*[column(c).alias(f"d{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(row.alias("row"), column(id_col).alias("doc_id"),
                       _key_udf(n)(column(text_col).cast("string")).alias("k_node"))
    # one row per node and task before the shuffle, however many copies it has
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), F.col("doc_id")))
    worded = rows.filter("k_node is not null").groupBy("k_node").agg(first.alias("row")).join(stay, "k_node", "left_semi")
    out = [F.col(f"row.d{i}").alias(c) for i, c in enumerate(docs.columns)]
    return worded.select(*out).union(rows.filter("k_node is null").select(*out))
