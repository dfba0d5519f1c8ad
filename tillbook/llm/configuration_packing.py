"""Best-fit packing by a configuration linear program over the lengths.

A *configuration* is a multiset of piece lengths that fits one sequence.  The
program "as few configurations as possible, every length covered as often as
it occurs" has one row per distinct length, so it is as large as the capacity,
however many documents there are:

1. each task tokenizes its documents, cuts those that are too long, and
   numbers its pieces of each length; the pieces are written once to the
   shared checkpoint folder (two later steps must see the same numbers);
2. the length histogram is one grouped count: at most ``capacity`` rows reach
   the driver;
3. ``solve`` prices configurations by a knapsack dynamic program under
   multiplicative weights (a length that is covered becomes cheaper);
   ``round_down`` makes whole numbers of them and packs the rest by best fit;
4. the result says, for the r-th piece of a length, which sequence and which
   offset it takes.  A piece's r is its number within its task plus the
   pieces of that length in earlier tasks: a table of tasks x lengths, whose
   rows are counted; up to ``SMALL`` of them it is broadcast and no piece is
   shuffled, beyond that the two are joined by task and length.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import bound_batches, id_text, loaded_tokenizer, sliced, stored, trim

ROUNDS = 500               # of pricing, at most
PRICED = 8                 # configurations made from one dynamic program
RATE = 0.003               # a length's price falls by exp(-RATE * share covered)
STEP = 0.5                 # of a length that one configuration may cover at once
LARGER = 0.002             # how much dearer, a token, a piece as long as a sequence is
SCALES = (1.0, 0.75, 0.5, 0.25)        # of the program's solution that rounding tries
WORDLESS = 10_000          # white space in a row that is left to the whole library
SMALL = 1 << 18            # rows of the table of earlier pieces that are broadcast (three numbers each)
OUT_ROWS, OUT_BYTES = 4096, 4 << 20    # pieces, and bytes of their ids, per output batch
SLICE_BYTES = 2 << 20      # of text taken from Arrow at once


# -- the program over the histogram (driver; bounded by the capacity) --------

@dataclass(frozen=True)
class Plan:
    """``slots``: (length, first rank, ranks, first sequence, offset): the
    pieces of a length from a rank on lie in consecutive sequences, all at
    one offset.  ``bound``: no packing has fewer sequences."""
    slots: list[tuple[int, int, int, int, int]]
    sequences: int
    bound: int


def knapsack(value, capacity: int):
    """``best[c]``: the greatest value of lengths that fit in ``c``, and
    ``last[c]``: one of them (0: the same as ``c - 1``).  ``value[l]`` is the
    price of length ``l``, minus infinity if there is none."""
    import numpy as np
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        sums = value[1:c + 1] + best[c - 1::-1] if c > 1 else value[1:2] + best[:1]
        at = int(sums.argmax())
        if sums[at] > best[c - 1]:
            best[c], last[c] = sums[at], at + 1
        else:
            best[c] = best[c - 1]
    return best, last


def traced(last, room: int) -> list[int]:
    """The lengths of the best filling of ``room``."""
    out = []
    while room > 0:
        n = int(last[room])
        if n:
            out.append(n)
        room -= n or 1
    return out


def solve(counts: dict[int, int], capacity: int) -> tuple[dict[tuple[int, ...], float], int]:
    """Configurations and how often each is used, in fractions, and a lower
    bound on the number of sequences of any packing.

    Multiplicative weights: a length's price is its share of the capacity
    times ``exp(-RATE * covered share)``; among equals larger pieces are
    dearer, so that small ones remain to fill what is left.  Each round one
    dynamic program prices the configurations.  The longest uncovered lengths
    are used in the best one that holds them, each for at most ``STEP`` of any
    length in it, if it is as full as a sequence of these lengths can be.  The
    rounds end when there is no such configuration.  Prices divided by the
    best configuration's solve the dual program, hence the bound.
    """
    import numpy as np
    lengths = np.array(sorted(counts), dtype=np.int64)
    wanted = np.zeros(capacity + 1)
    wanted[lengths] = [counts[n] for n in lengths.tolist()]
    covered, used, full = np.zeros(capacity + 1), {}, None
    # at least the volume; at least one sequence for each piece over the half
    bound = max(math.ceil((wanted * np.arange(capacity + 1)).sum() / capacity),
                int(wanted[capacity // 2 + 1:].sum()))
    for _ in range(ROUNDS):
        live = lengths[covered[lengths] < wanted[lengths] - 1e-9]
        if not len(live):
            break
        value, size = np.full(capacity + 1, -np.inf), live / capacity
        value[live] = size * (1 + LARGER * size) * np.exp(-RATE * covered[live] / wanted[live])
        best, last = knapsack(value, capacity)
        if full is None:
            full = sum(traced(last, capacity))
            dual = (wanted[live] * value[live]).sum() / best[capacity]
            bound = max(bound, math.ceil(dual - 1e-6 * max(1.0, dual)))
        done = 0
        for n in live[::-1].tolist():
            config = tuple(sorted([n, *traced(last, capacity - n)], reverse=True))
            if sum(config) < full:
                continue
            amount = min(min(STEP * wanted[k], wanted[k] - covered[k]) / config.count(k) for k in set(config))
            if amount <= 0:
                continue
            used[config] = used.get(config, 0.0) + float(amount)
            for k in config:
                covered[k] += amount
            done += 1
            if done == PRICED:
                break
        if not done:
            break
    return used, bound


def round_down(counts: dict[int, int], capacity: int, used: dict[tuple[int, ...], float]
               ) -> list[tuple[tuple[int, ...], int]]:
    """Whole configurations that hold every piece exactly once: those of the
    program rounded down and the remaining pieces by best fit.  With few
    pieces of each length rounding is coarse, so parts of the solution
    (``SCALES``) are tried and the fewest sequences win."""
    best = None
    for scale in SCALES:
        left, out = dict(counts), []
        for config, amount in sorted(used.items(), reverse=True):
            times = {n: config.count(n) for n in config}
            take = min([math.floor(scale * amount + 1e-6)] + [left[n] // k for n, k in times.items()])
            if take > 0:
                out.append((config, take))
                for n, k in times.items():
                    left[n] -= k * take
        out += best_fit(left, capacity)
        if best is None or sum(k for _, k in out) < sum(k for _, k in best):
            best = out
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: sequences of equal contents are
    one entry with a count, so the work follows the number of lengths."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in sorted(counts, reverse=True):
        k = counts[n]
        while k > 0:
            room = next((r for r in range(n, capacity) if open_.get(r)), None)
            if room is None:      # one piece each, up to as many as fill whole sequences
                new = -(-k // (capacity // n))
                open_.setdefault(capacity - n, []).append(((n,), new))
                k -= new
                continue
            config, times = open_[room].pop()
            take = min(k, times)
            open_.setdefault(room - n, []).append((config + (n,), take))
            if take < times:
                open_[room].append((config, times - take))
            k -= take
    return [group for groups in open_.values() for group in groups]


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Where every piece goes, from the number of pieces of each length
    (1 to ``capacity``).  A piece as long as a sequence has one for itself."""
    whole = counts.get(capacity, 0)
    rest = {n: k for n, k in counts.items() if n < capacity and k > 0}
    used, bound = solve(rest, capacity) if rest else ({}, 0)
    configs = round_down(rest, capacity, used) + ([((capacity,), whole)] if whole else [])
    slots, rank, sequence = [], {}, 0
    for config, times in configs:
        at = 0
        for n in config:
            slots.append((n, rank.get(n, 0), times, sequence, at))
            rank[n] = rank.get(n, 0) + times
            at += n
        sequence += times
    return Plan(sorted(slots), sequence, bound + whole)


# -- tokenizing --------------------------------------------------------------

class Encoder:
    """Ids of whole texts as the ``tokenizers`` library gives them for a
    byte-level BPE file, without added special tokens around them.

    Where the file's merges are in the order of the ids they make, the ids
    are those of a rank table, which ``tiktoken`` applies faster; the table is
    made from the file itself.  Texts that hold an added token, or white space
    in runs so long that its pattern gives up, go to the whole library, and
    so does every text if the file is of another kind.
    """

    def __init__(self, path: str):
        self.whole = loaded_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            self.fast, self.added = self._ranked(json.load(f))

    @staticmethod
    def _ranked(file: dict):
        added = [t["content"] for t in file["added_tokens"]]
        model, pre = file["model"], file["pre_tokenizer"] or {}
        plain = (model.get("type") == "BPE" and not file["normalizer"] and pre.get("type") == "ByteLevel"
                 and pre.get("use_regex") and not pre.get("add_prefix_space")
                 and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                                    "byte_fallback", "ignore_merges")))
        if not plain:
            return None, added
        import public_tokenizers
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel
        # the byte-level step's character for each byte, read off the library
        write = ByteLevel(add_prefix_space=False, use_regex=False)
        byte_of = {}
        for code in [*range(0x801), *range(0x1000, 0x110000, 0x1000)]:
            if not 0xD800 <= code < 0xE000:
                raw = chr(code).encode("utf-8")
                byte_of.update(zip(write.pre_tokenize_str(chr(code))[0][0], raw))
        if len(byte_of) < 243:      # the bytes that occur in UTF-8
            return None, added
        vocab, ranks = model["vocab"], {}
        for token, i in vocab.items():
            if token not in added:
                if any(c not in byte_of for c in token):
                    if len(token) > 1:
                        return None, added
                    continue        # a byte that no text holds
                ranks[bytes(byte_of[c] for c in token)] = i
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        singles = [i for token, i in ranks.items() if len(token) == 1]
        if any(a >= b for a, b in zip(made, made[1:])) or not made or max(singles) >= made[0]:
            return None, added
        for byte in range(256):     # the rank table must be whole; these are never asked for
            ranks.setdefault(bytes([byte]), len(vocab) + byte)
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={}), added

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast is None or any(t in text for t in self.added) or long_space(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)


def long_space(text: str, length: int = WORDLESS) -> bool:
    """Whether ``length`` white-space characters follow each other.  Such a
    run covers two neighbouring multiples of half its length, so few texts
    are searched."""
    sampled = [c.isspace() for c in text[::length // 2]]
    return any(a and b for a, b in zip(sampled, sampled[1:])) and re.search(rf"\s{{{length}}}", text) is not None


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids: whole
    sequences but for the first."""
    at, take = 0, n % capacity or min(n, capacity)
    while at < n:
        yield at, take
        at, take = at + take, capacity


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, with the task that made it (``part``) and how many
    pieces of its length that task made before it (``nth``)."""
    bound_batches(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])
    end = struct.pack("<I", end_id)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        encoder, seen, out, held = Encoder(tokenizer), [0] * (capacity + 1), [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

        for batch in batches:
            at = 0
            doc_ids = batch.column(0).to_pylist()
            for texts in sliced(batch.column(1), SLICE_BYTES):
                for text in texts.to_pylist():
                    ids = (encoder.encode(text) if text else b"") + end
                    n = len(ids) // 4
                    for k, (start, length) in enumerate(cuts(n, capacity)):
                        out.append((doc_ids[at], k, start, length, ids[4 * start:4 * (start + length)], n, part,
                                    seen[length]))
                        seen[length] += 1
                        held += 4 * length
                        if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                            yield flush()
                            out, held = [], 0
                    at += 1
        if out:
            yield flush()
        del encoder
        trim()

    return stored(rows.mapInArrow(run, schema), "pieces")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document of ``docs`` into few sequences of at most ``capacity`` ids.

    A document's ids are the tokenizer's for its whole text, without special
    tokens around them, then ``end_id``.  Only a document of more than
    ``capacity`` ids is cut: into pieces of ``capacity``, the first of which
    may be shorter.  One row per piece: ``doc_id``, ``piece`` (from 0),
    ``start`` (ids of the document before it), ``length``, ``ids`` (binary,
    little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` (from 0,
    gapless) and ``offset`` (ids before it in its sequence).

    A null or empty text is a document of ``end_id`` alone; a null id is
    kept; repeated rows are packed each; an empty table gives no rows; other
    columns of ``docs`` are ignored.  Texts of any length are cut over as many
    sequences as they need.  Which of several pieces of one length takes which
    place follows the order in which they were read.
    """
    rows = pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    per_part = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    of_length = per_part.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).collect()
    slots = plan({r["length"]: r["n"] for r in of_length}, capacity).slots
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    if sum(r["parts"] for r in of_length) <= SMALL:
        first = F.broadcast(first)      # beyond that the pieces are shuffled by task and length
    place = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(place)
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        import numpy as np
        import pandas as pd
        table = np.array(slots, dtype=np.int64)
        # one number orders (length, rank): a rank is below 2 to the 48th
        key = (table[:, 0] << 48) + table[:, 1]
        at = np.searchsorted(key, (length.to_numpy() << 48) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + rank.to_numpy() - table[at, 1], "offset": table[at, 4]})

    return (rows.join(first, ["part", "length"])
            .withColumn("_place", placed("length", F.col("first") + F.col("nth")))
            .select("doc_id", "piece", "start", "length", "ids", "doc_tokens", "_place.sequence_id", "_place.offset"))
