"""Secret scans: keyword prefilter, anchored patterns, checksums.

One Aho-Corasick pass over the lower-cased text finds where a keyword of any
rule begins; the rule's regular expression is matched only there, anchored.
Hexadecimal runs have no keyword: the text is mapped to "hex digit or not"
and searched for the keyword of 32 hex digits in a row.  No rule reads a stretch
of text again for each of its hits, so a scan is linear in the text.  Rules whose tokens
carry a checksum (the CRC-32 in base 62 at the end of a token, the JSON
header of a signed web token, the Luhn digit of a card number) are validated
before a span is reported.  The span of a private key holds the whole key.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import bound_batches, column, id_text, trim

# Base rules (kind, keywords, pattern at a keyword, shortest)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
BASE_KINDS = ("assign", "access", "hex")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
# Public token formats with an embedded check
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
# what the first part of a web token runs to, and what must follow it
JWT_RUN, JWT_REST = re.compile(r"[A-Za-z0-9_-]*+"), re.compile(r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]")
CARD = re.compile(r"(?:card|visa|mastercard)[\"']?\x20*+(?:(?:number|no\.?)\x20*+)?(?:[:=#]\x20*+)?"
                  r"((?:\d[\x20-]?){12,18}\d)(?!\d)", re.ASCII | re.IGNORECASE)
# From BEGIN to the matching END line with no other BEGIN or END between; if
# there is none, to the end of the base64 after it: lines of a text that may be
# quoted, commented out, escaped or joined, the last one also a short word
PRIVATE_KEY = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----(?:"
    r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END \1-----|"
    r"(?:(?:[\s\"'>#*|,]|\\+[nrt]?|\+(?=\s))*+(?:(?:Proc-Type|DEK-Info):[ \t]*[^\s\\]+|[A-Za-z0-9+/=]{16,}+|"
    r"(?=[A-Za-z]*(?:[0-9+/=]|[a-z][A-Z]))[A-Za-z0-9+/=]++))*+"
    r"(?:(?:[\s\"'>#*|,]|\\+[nrt]?)*+[A-Za-z0-9+/=]++(?=[ \t\r]*(?:\n|\Z|\\+[nr]|[\"'])))?+)")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_MAP = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "card", "private_key")


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


def _check(kind: str, m: re.Match) -> bool:
    if kind in ("github", "npm"):
        return base62_crc(m[1]) == m[2]
    if kind == "jwt":
        return _json_part(m[1]) and _json_part(m[2])
    if kind == "card":
        digits = re.sub(r"\D", "", m[1])
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "assign":
        return len(m[2]) >= MIN_VALUE
    return kind != "access" or len(m[0]) >= MIN_ACCESS


RULES = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT, "card": CARD,
         "private_key": PRIVATE_KEY}
KEYWORDS = {**{w: "assign" for w in ASSIGN_WORDS}, "akia": "access",
            **{w: "github" for w in GITHUB_WORDS}, "npm_": "npm", "eyj": "jwt",
            "card": "card", "visa": "card", "mastercard": "card", "-----begin ": "private_key"}


class Scanner:
    def __init__(self):
        import ahocorasick
        self.words = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.words.add_word(word, (kind, len(word)))
        self.words.make_automaton()

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, by start, then kind as listed."""
        if not text:
            return []
        data = text.encode("utf-8")
        low = data.lower()                  # A-Z only, so places stay the same
        found, reach = [], dict.fromkeys(RULES, 0)
        hits = sorted((end - n + 1, kind) for end, (kind, n) in self.words.iter(low.decode("utf-8")))
        run, token = 0, False               # the end of a run of token characters; is it a web token's first part
        for start, kind in hits:
            if start < reach[kind]:
                continue
            if kind == "jwt":               # a run is read once, however many hits it holds
                if start >= run:
                    run = JWT_RUN.match(text, start).end()
                    token = JWT_REST.match(text, run) is not None
                if not token:
                    continue
            m = RULES[kind].match(text, start)
            if m:                           # even a match that fails its check takes its place
                reach[kind] = m.end()
                if _check(kind, m):
                    found.append((start, m.end(), kind))
        mapped, at = data.translate(_HEX_MAP), 0
        needle, start, shift = b"1" * MIN_HEX, 0, 0
        while (start := mapped.find(needle, at)) >= 0:
            stop = mapped.find(b"0", start)
            stop = len(mapped) if stop < 0 else stop
            shift += len(data[at:start].decode("utf-8")) - (start - at)
            found.append((start + shift, stop + shift, "hex"))
            at = stop
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                      T.StructField("kind", T.StringType())])


@F.arrow_udf(T.ArrayType(_SPAN))
def _spans(text):
    import pyarrow as pa
    scan = Scanner().spans
    return pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in scan(t.as_py())] for t in text],
                    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))


@F.arrow_udf(T.StringType())
def _masked(text, mark):
    import pyarrow as pa
    scan, out = Scanner().spans, []
    for t, m in zip(text, mark):
        t, m, at, parts = t.as_py(), m.as_py(), 0, []
        for a, b, _ in scan(t):
            if b > at:
                parts += [t[at:a], m] if a >= at else []
                at = b
        out.append(t if not parts else "".join([*parts, t[at:]]))
    trim()
    return pa.array(out, pa.string())


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (array of start, end, kind; code points, end
    exclusive; by start, then kind) of every row of ``docs``.

    A null or empty text has no spans; null ids and repeated rows are kept
    as they are; an empty table gives no rows; other columns are ignored;
    whole texts are read, whatever their length.
    """
    bound_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).select("doc_id", _spans("text").alias("spans"))


def masked(text: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every secret span replaced by ``mark`` (overlapping spans
    by one); null stays null."""
    return _masked(text.cast("string"), F.lit(mark))


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]",
                 chars_col: str | None = None) -> DataFrame:
    """``docs`` with ``text_col`` masked; ``chars_col``, if given, becomes the
    length of the texts that changed.  Other columns and rows stay: a null or
    empty text as it is, repeated rows each, null ids; an empty table gives no
    rows."""
    bound_batches(docs.sparkSession)
    new = masked(column(text_col), mark)
    out = {text_col: new}
    if chars_col:
        kind = docs.schema[chars_col].dataType
        out[chars_col] = F.when(new.eqNullSafe(column(text_col)), column(chars_col)).otherwise(F.length(new).cast(kind))
    return docs.select(*[out[c].alias(c) if c in out else column(c) for c in docs.columns])
