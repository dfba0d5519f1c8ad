"""Language identification of web pages by Bayesian evidence fusion.

``log P(lang | page) ~ TEMPER * log P(text | lang) + log P(declared | lang)
+ log P(suffix | lang) + log P(lang | host)``

* text: hashed letter trigrams, a naive Bayes model of every language that
  any document has, fitted on a bounded sample of each one's documents
  (``max_train`` a language, those with the smallest hash of their id); the
  temper accounts for neighbouring trigrams not being independent;
* declared: the primary subtag of the markup's ``lang`` attribute;
* suffix: the last label of the address's host;
* host: a prior smoothed up the hierarchy host -> domain (last two labels)
  -> all pages, without the page's own part.

The last three are grouped sums, over all pages, of the text posteriors; a
host with a third of all pages is summed per task first.  Their tables are
joined back by key, a hot key's pages dealt over several tasks; the pages then
carry a few numbers only, never a text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import column, stored
from tillbook.operators.skew import join_per_key

BINS = 1 << 14
TEMPER = 0.05
STRENGTH = 10.0            # pages' worth of the level above in a host's prior
_BLOCK = re.compile(r"<(script|style)\b", re.IGNORECASE)
_BLOCK_END = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in ("script", "style")}
_HTML = re.compile(r"<html\b", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?([A-Za-z]+)", re.IGNORECASE)
_HUGE_NUMBER = re.compile(r"&#[0-9]{1000,};?")     # more digits than Python reads


def visible(html: str | None) -> str:
    """The page's text without markup, scripts, styles and comments.

    One pass by position: what closes a comment, a script or a tag is looked
    for once, and what was not found before is not looked for again, so a page
    of unclosed markup takes no longer than another."""
    import html as entities
    if not html:
        return ""
    out, at, comments, blocks = [], 0, True, {"script", "style"}
    while (lt := html.find("<", at)) >= 0:
        end = -1
        if comments and html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            comments = end >= 0
            end = end + 3 if comments else -1
        elif (m := _BLOCK.match(html, lt)) and (name := m[1].lower()) in blocks:
            closing = _BLOCK_END[name].search(html, m.end())
            if closing:
                end = closing.end()
            else:
                blocks.discard(name)
        if end < 0:
            end = html.find(">", lt + 1) + 1
        if not end:                     # nothing after this is closed
            break
        out += [html[at:lt], " "]
        at = end
    out.append(html[at:])
    return entities.unescape(_HUGE_NUMBER.sub("\ufffd", "".join(out)))


def declared(html: str | None) -> str:
    """Primary subtag of the declared language, lower-cased; "" without one."""
    at = 0
    while html and (tag := _HTML.search(html, at)):
        end = html.find(">", tag.end())
        end = len(html) if end < 0 else end
        m = _LANG.search(html, tag.end(), end)
        if m:
            return m[1].lower()
        at = end                        # tags opened within this one hold no more than it
    return ""


def trigram_bins(text: str):
    """Bins of the letter trigrams of a text; words are lower-cased and
    set off by one space."""
    import numpy as np
    s = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    if len(s) < 3:
        return np.empty(0, dtype=np.int64)
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(50)).astype(np.int64)


def fit(documents: DataFrame, max_train: int = 4000):
    """(languages, log probabilities per language and bin) from ``documents``
    (``doc_id``, ``text``, ``lang``), ``max_train`` of each language; rows
    without a language are not used, rows without an id count by their text."""
    import numpy as np
    text, key = column("text").cast("string"), column("doc_id")
    known = documents.select(column("lang"), text.alias("text"), F.when(key.isNull(), F.xxhash64(text))
                             .otherwise(F.xxhash64(key)).alias("hash")).filter("lang is not null")
    ids = stored(known.select("lang", "hash").distinct(), "language-ids")
    # hashes are even: about twice as many as wanted are small enough to be ranked, or all
    few = (ids.join(F.broadcast(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))), "lang")
           .filter(F.col("hash") / 2.0 ** 64 + 0.5 <= (2.0 * max_train + 100) / F.col("n")))
    limits = (few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash")))
              .filter(F.col("rank") <= max_train).groupBy("lang").agg(F.max("hash").alias("most")))

    def run(batches):
        import pyarrow as pa
        sums: dict[str, object] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = np.bincount(trigram_bins(text.as_py() or ""), minlength=BINS)
                sums[lang] = sums[lang] + n if lang in sums else n
        for lang, n in sums.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()),
                                              pa.array(n[at], pa.int64())], names=["lang", "bin", "n"])

    # the sample is bounded by max_train ids a language, the counts by languages x BINS
    counts = (known.join(F.broadcast(limits), "lang").filter("hash <= most").select("lang", "text")
              .mapInArrow(run, "lang string, bin long, n long")
              .groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(r["lang"] for r in ids.select("lang").distinct().collect())
    place = {lang: i for i, lang in enumerate(langs)}
    table = np.full((len(langs), BINS), 0.5)
    if langs:
        table[[place[x] for x in counts["lang"].to_pylist()], counts["bin"].to_numpy()] += counts["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _evidence(pages: DataFrame, logs, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id``, ``ll`` (tempered log likelihoods), ``q`` (text posterior),
    ``declared``, ``host``, ``domain``, ``suffix``."""
    kind = T.StructType([T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("q", T.ArrayType(T.DoubleType())),
                         T.StructField("declared", T.StringType())])

    @F.arrow_udf(kind)
    def text_evidence(html):
        import numpy as np
        import pyarrow as pa
        ll, q, said = [], [], []
        for value in html:
            page = value.as_py()
            bins = trigram_bins(visible(page))
            x = TEMPER * logs[:, bins].sum(axis=1)
            x -= x.max()
            p = np.exp(x)
            ll.append(x.tolist())
            q.append((p / p.sum()).tolist())
            said.append(declared(page))
        arrays = [pa.array(ll, pa.list_(pa.float64())), pa.array(q, pa.list_(pa.float64())), pa.array(said, pa.string())]
        return pa.StructArray.from_arrays(arrays, names=kind.names)

    url = F.coalesce(column(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return (pages.select(column(id_col).alias("page_id"), host.alias("host"),
                         text_evidence(column(html_col).cast("string")).alias("e"))
            .select("page_id", "host", F.substring_index("host", ".", -2).alias("domain"),
                    F.substring_index("host", ".", -1).alias("suffix"), "e.*"))


def identify(pages: DataFrame, documents: DataFrame, max_train: int = 4000, id_col: str = "page_id",
             url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``lang``, ``score`` (posterior of ``lang``, 6 digits),
    ``text_lang`` (from the text alone), ``declared``, ``host``, ``suffix`` of
    every row of ``pages``.

    A null or empty page has no text evidence, a null or unparsable address
    the host "": the other evidence and the priors decide.  Ties go to the
    first language in alphabetical order.  Without documents of known
    language ``lang`` is null.  Null ids and repeated rows are kept as they
    are; an empty table gives no rows; other columns are ignored.
    """
    langs, logs = fit(documents, max_train)
    names, size = F.array(*map(F.lit, langs)) if langs else F.array().cast("array<string>"), len(langs)
    if not langs:
        logs = logs.reshape(0, BINS)
        return (pages.select(column(id_col).alias("page_id"))
                .select("page_id", *[F.lit(None).cast(t).alias(c) for c, t in (
                    ("lang", "string"), ("score", "double"), ("text_lang", "string"), ("declared", "string"),
                    ("host", "string"), ("suffix", "string"))]))
    rows = stored(_evidence(pages, logs, id_col, url_col, html_col), "language-evidence")

    def sums(name: str):
        return F.array(*[F.sum(F.col("q")[i]) for i in range(size)]).alias(name)

    total = [x or 0.0 for x in rows.agg(sums("all")).first()["all"]]
    everything = F.array(*map(F.lit, total))
    joined, kinds = rows, {}
    for key in ("declared", "suffix", "domain", "host"):
        # written once: the plan of the four joins holds each of them once, however often it is read
        by = stored(rows.groupBy(key).agg(sums(f"by_{key}"), F.count(F.lit(1)).alias("_n")), f"language-by-{key}")
        if key in ("declared", "suffix"):
            kinds[key] = by.count()                # of different values
        joined = join_per_key(joined, by.drop("_n"), [key], "inner", counts=by.select(key, "_n"))

    def likelihood(by: str, kinds: int):
        return lambda x, i: F.log((F.col(by)[i] + 0.5) / (everything[i] + 0.5 * kinds))

    def prior(i):
        own = F.col("q")[i]
        all_p = (everything[i] - own + 1.0) / (sum(total) - 1.0 + size)
        domain_n = F.aggregate("by_domain", F.lit(0.0), lambda a, x: a + x) - 1.0
        domain_p = (F.col("by_domain")[i] - own + STRENGTH * all_p) / (domain_n + STRENGTH)
        host_n = F.aggregate("by_host", F.lit(0.0), lambda a, x: a + x) - 1.0
        return F.log(F.greatest((F.col("by_host")[i] - own + STRENGTH * domain_p) / (host_n + STRENGTH), F.lit(1e-12)))

    declared_l, suffix_l = likelihood("by_declared", kinds["declared"]), likelihood("by_suffix", kinds["suffix"])
    fused = F.transform("ll", lambda x, i: x + declared_l(x, i) + suffix_l(x, i) + prior(i))
    best = F.array_max("z")
    at = F.array_position("z", best).cast("int")
    share = F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    return (joined.withColumn("z", fused)
            .select("page_id", F.element_at(names, at).alias("lang"), F.round(share, 6).alias("score"),
                    F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")).alias("text_lang"),
                    "declared", "host", "suffix"))
