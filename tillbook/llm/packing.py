"""Harmonic packing of token ids into fixed-capacity training sequences.

Class ``j`` holds pieces whose length lies in ``(C/(j+1), C/j]`` for capacity
``C``; a bin of class ``j`` always takes exactly ``j`` pieces, so a bin is
full by counting and no worker needs to know about another's bins.  Plain
harmonic bins waste up to ``1 - j/(j+1)``; documents may be cut, so a
document's tail that would waste more than ``tolerance`` of its slot first
gives up a piece of the reciprocal length ``C // (j+1)`` (which fills a slot
of its class exactly, up to rounding) and the rest is classed again.

Each Spark task packs the documents of its own partition: no shuffle, no
group to gather, and a lost task is redone from its input alone.  At the end
of a task the unfinished bins (under one capacity of ids per class, at most
``2 * sqrt(C)`` classes) are laid end to end and cut at the capacity; the
last, partial run is cut into power-of-two sequences, which need no padding.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillbook.llm.common import bound_batches, id_text, loaded_tokenizer, sliced, trim

CACHE_WORDS = 50_000       # words whose ids a worker remembers
LONG_WORD = 64             # bytes; longer words are not remembered
OUT_ROWS, OUT_BYTES = 4096, 4 << 20    # pieces, and bytes of their ids, per output batch


# ASCII punctuation, and lower-case Latin words, which the
# tokenizer's normalisation leaves as they are
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN_WORD = re.compile("[a-zß-öø-ÿ]+")
SPECIAL, MARKS = "<|", "[\u0300-\u036f]"
SLICE_BYTES = 1 << 20      # of text whose words are numbered at once


class WordEncoder:
    """Ids of whole texts from the ids of their distinct words.

    The tokenizer lower-cases, drops white space, and no token crosses white
    space or the end of a run of letters.  So a text's ids are the ids of its
    ASCII-space-separated words in order (other white space stays inside a
    word and is left to the tokenizer), and those of a Latin word that ends in
    punctuation are the ids of the two parts.  Words count as equal with A-Z
    lower-cased, unless the text holds a special token's opening or combining
    marks, whose composition could depend on the case.

    Words are split and numbered by Arrow, each distinct one is encoded once
    per batch at most, and the ids are put in place by their numbers.  Plain
    lower-case Latin words go to the tokenizer's model alone; whatever else
    is new is left to the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = loaded_tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.word_bytes = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        # how the byte-level step writes the letters beyond ASCII
        write = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: write.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, in order."""
        known, word = self.known, self.word_bytes
        if len(known) > CACHE_WORDS:
            known.clear()
        tokenize, rest, fresh, out = self.tokenizer.model.tokenize, [], {}, []

        def latin(core: str) -> bytes:
            ids = tokenize(core if core.isascii() else core.translate(self.letters))
            ids = word[ids[0].id] if len(ids) == 1 else b"".join([word[t.id] for t in ids])
            fresh[core] = ids
            return ids

        halves = {}
        for w in words:
            ids = known.get(w) or fresh.get(w)
            if ids is None:
                if LATIN_WORD.fullmatch(w):
                    ids = latin(w)
                else:
                    core = w.rstrip(PUNCTUATION)
                    if len(core) < len(w) and LATIN_WORD.fullmatch(core):
                        halves[len(out)] = w[len(core):]
                        ids = known.get(core) or fresh.get(core) or latin(core)
                    else:
                        rest.append(len(out))
            out.append(ids)
        tails = [t for t in dict.fromkeys(halves.values()) if t not in known]
        whole = [words[i] for i in rest] + tails
        for at in range(0, len(whole), 1024):
            for w, e in zip(whole[at:at + 1024], self.tokenizer.encode_batch_fast(
                    whole[at:at + 1024], add_special_tokens=False)):
                fresh[w] = b"".join([word[i] for i in e.ids])
        for i in rest:
            out[i] = fresh[words[i]]
        for i, tail in halves.items():
            out[i] += fresh[tail] if tail in fresh else known[tail]
        known.update({w: ids for w, ids in fresh.items() if len(w) <= LONG_WORD})
        return out

    def encode(self, texts) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids per text of an Arrow string
        array; null counts as empty."""
        import numpy as np
        import pyarrow.compute as pc
        for part in sliced(texts, SLICE_BYTES):
            part = pc.fill_null(part, "")
            as_is = pc.or_(pc.match_substring(part, SPECIAL), pc.match_substring_regex(part, MARKS))
            words = pc.ascii_split_whitespace(pc.if_else(as_is, part, pc.ascii_lower(part)))
            ends = words.offsets.to_numpy()
            coded = words.flatten().dictionary_encode()
            place = coded.indices.to_numpy()
            ids = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            first = np.cumsum(size) - size
            n = size[place]
            stops = np.cumsum(n)
            total = int(stops[-1]) if len(stops) else 0
            data = flat[np.repeat(first[place] - (stops - n), n) + np.arange(total)].tobytes()
            cut = np.concatenate([[0], stops])[ends - ends[0]].tolist()
            for a, b in zip(cut, cut[1:]):
                yield data[4 * a:4 * b]


def cuts(n: int, capacity: int, tolerance: float) -> Iterator[int]:
    """Piece lengths of a document of ``n`` ids, in order."""
    while n > 0:
        if n >= capacity:
            take = capacity
        else:
            j = capacity // n
            take = n if capacity - j * n <= tolerance * capacity else capacity // (j + 1)
        yield take
        n -= take


class HarmonicPacker:
    """Bins of one worker.  ``add`` and ``finish`` yield finished sequences:
    lists of (document fields, start, ids)."""

    def __init__(self, capacity: int, tolerance: float):
        self.capacity, self.tolerance = capacity, tolerance
        self.open: dict[int, list] = {}

    def add(self, doc: tuple, ids: bytes) -> Iterator[list]:
        at = 0
        for n in cuts(len(ids) // 4, self.capacity, self.tolerance):
            j = self.capacity // n
            bin_ = self.open.setdefault(j, [])
            bin_.append((doc, at, ids[4 * at:4 * (at + n)]))
            at += n
            if len(bin_) == j:
                yield self.open.pop(j)

    def finish(self) -> Iterator[list]:
        """Unfinished bins end to end, cut at the capacity; the tail in
        power-of-two sequences."""
        rest = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        left = sum(len(p[2]) for p in rest) // 4
        pieces = iter(rest)
        current = next(pieces, None)
        while left:
            room = min(self.capacity, 1 << (left.bit_length() - 1)) if left < self.capacity else self.capacity
            left -= room
            seq = []
            while room:
                doc, start, ids = current
                n = min(room, len(ids) // 4)
                seq.append((doc, start, ids[:4 * n]))
                room -= n
                current = (doc, start + n, ids[4 * n:]) if 4 * n < len(ids) else next(pieces, None)
            yield seq


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1,
         tolerance: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document of ``docs`` into sequences of at most ``capacity`` ids.

    A document's ids are the tokenizer's for its whole text, without special
    tokens, then ``end_id``.  One row per piece: ``doc_id``, ``start`` (ids
    of the document before it), ``length``, ``ids`` (binary, little-endian
    unsigned 32-bit), ``doc_tokens`` (ids of the document), ``sequence_id``,
    ``offset`` (ids before it in its sequence) and ``sequence_length``.
    ``tolerance`` is the share of a slot a whole tail may leave unused.

    A null or empty text is a document of ``end_id`` alone; a null id is kept;
    repeated rows are packed each; an empty table gives no rows; other
    columns of ``docs`` are ignored.  Texts of any length are cut over as
    many sequences as they need.
    """
    bound_batches(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("sequence_length", T.LongType())])
    end = struct.pack("<I", end_id)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encoder, packer = WordEncoder(tokenizer), HarmonicPacker(capacity, tolerance)
        sequence = TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        held = 0

        def close(seq):
            nonlocal sequence, held
            total, at = sum(len(ids) for _, _, ids in seq) // 4, 0
            for (doc_id, doc_tokens), start, ids in seq:
                n = len(ids) // 4
                out.append((doc_id, start, n, ids, doc_tokens, sequence, at, total))
                at += n
            sequence += 1
            held += 4 * total

        def flush():
            nonlocal held
            held = 0
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                ids += end
                for seq in packer.add((doc_id, len(ids) // 4), ids):
                    close(seq)
                if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                    yield flush()
        for seq in packer.finish():
            close(seq)
            if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                yield flush()
        if out:
            yield flush()
        del encoder
        trim()

    return rows.mapInArrow(run, schema)
