"""Each operator against a brute-force version, on the smallest driver table
plus rows with nulls, empty and long texts, repeated rows and clashing column
names, and on an empty table."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from tillbook.llm import (components, factorisation, fingerprints, language_id, license_scan, ngram_join, packing,
                          queries, rules, secret_scan, sentencepieces, token_counts)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, ids string, "
          "`a.b c` string, spans int, class_id string, fp string, f string, s string, level string, node string")
TRICKY = [None, "", " ", "\n", "a", "word " * 30_000, "x" * 70_000, "Ä b  c\n\n d\te\x0b", "▁a▁▁b <s> </s>",
          "İSTANBUL token: ſecret=12345678   A", "THE QUICK brown", "the quick BROWN", "😀 é ́ 日本語",
          "token=secret=abcdefgh AKIAABCDEFGHIJKLMN " + "0af" * 20, "<|endoftext|>a <|startoftext|>\x00b\x1cc",
          "Released under the MIT License.\n\nThis work is licensed\nunder the GNU General Public License, version 3.\n"]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(10_000 + i, t, None if i % 3 else "en", None, None) for i, t in enumerate(TRICKY)]
    rows += [(None, "no id here", "en", None, 3), (None, None, None, None, None), (10_005, "same id, other text", "en", None, 1)]
    rows += [rows[7], rows[7], rows[10]]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = base.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).union(extra)
    for c in ("kept", "ids", "a.b c", "class_id", "fp", "f", "s", "level", "node"):
        out = out.withColumn(c, F.lit("x"))
    return out.withColumn("spans", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    own = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 0, 0), (2, 1, 0), (99_999_999, 1, 0)],
                                "doc_id long, quality int, toxic int")
    return spark.read.parquet(f"{SF001}/labels.parquet").selectExpr(
        "doc_id", "cast(quality as int) quality", "cast(toxic as int) toxic").union(own)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return Counter(tuple(r) for r in rows)


# 1 packing

def test_packing_is_a_partition_of_the_library_ids(docs, plain):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.WORD_TOKENIZER)
    want = bag((i, struct.pack(f"<{len(e) + 1}I", *e, 1)) for i, e in (
        (i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in plain))
    rows = packing.pack(docs, queries.WORD_TOKENIZER).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences[r["sequence_id"]].append(r)
    padding = total = 0
    for seq in sequences.values():
        seq.sort(key=lambda r: r["offset"])
        size = sum(r["length"] for r in seq)
        assert [r["offset"] for r in seq] == [sum(x["length"] for x in seq[:i]) for i in range(len(seq))]
        assert all(r["sequence_length"] == size for r in seq) and size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
        total += size
    assert padding <= 0.02 * total
    # a document's pieces, put in order, are its ids; repeated ids share starts
    got = Counter()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for (i, n), pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) % n == 0
        copies = sum(r["length"] for r in pieces) // n
        if copies == 1:
            assert [r["start"] for r in pieces] == [sum(x["length"] for x in pieces[:k]) for k in range(len(pieces))]
            got[i, b"".join(r["ids"] for r in pieces)] += 1
    assert all(want[k] == 1 for k in got) and sum(got.values()) >= len(plain) - 12


def test_word_encoder_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer
    tok, own = Tokenizer.from_file(queries.WORD_TOKENIZER), packing.WordEncoder(queries.WORD_TOKENIZER)
    rng = np.random.default_rng(3)
    parts = ["don't", "'s", "x'S", "Été", "e\u0301t", "T\u0308", "I\u0307", "ΟΔΟΣ", "İ", "ß", "12.5", "a1b", "²", "ª", "…", "”", "”.", ".”",
             "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "日本", "\x1c", "\x85", "\xa0", "\u2003", "_", "a_b", "-", "WORD", "word,", "ŉ", "ĳ", "Œuvre", "😀"]
    seps = [" ", "  ", "\n", "\t", ""]
    texts = ["".join(p + s for p, s in zip(rng.choice(parts, n), rng.choice(seps, n))) for n in rng.integers(0, 12, 3000)]
    for lo in range(0, len(texts), 300):
        part = texts[lo:lo + 300]
        want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tok.encode_batch(part, add_special_tokens=False)]
        for t, a, b in zip(part, list(own.encode(pa.array(part))), want):
            assert a == b, t
    monkeypatch.setattr(packing, "SLICE_BYTES", 40)
    array = pa.array([None, "", *part, " ", "w " * 50]).slice(1)
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tok.encode_batch([t or "" for t in array.to_pylist()], add_special_tokens=False)]
    assert list(own.encode(array)) == want


def test_packing_classes_and_cuts():
    for n in (1, 2, 7, 682, 683, 1023, 1024, 1025, 1365, 1900, 2047, 2048, 2049, 5000):
        parts = list(packing.cuts(n, 2048, 0.02))
        assert sum(parts) == n
        for p in parts:
            j = 2048 // p
            assert 2048 / (j + 1) < p <= 2048 / j and j * p >= 0.97 * 2048
    packer = packing.HarmonicPacker(2048, 0.02)
    done = [s for k in range(5) for s in packer.add((k,), b"\0" * 4 * 512)]
    assert [len(s) for s in done] == [4]
    assert [sum(len(i) for *_, i in s) // 4 for s in packer.finish()] == [512]


# 2 quality rules

def slow_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_rule_statistics_and_verdict(docs, plain, labels):
    rows = rules.judge(docs, labels).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert bag((r["doc_id"], *(r[f] for f in fields), r["base_failed"]) for r in rows) == bag(
        (i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]) for i, s in ((i, slow_stats(t)) for i, t in plain))
    # the verdict from the definition
    quality = {}
    for r in labels.filter("doc_id is not null and quality is not null").collect():
        quality[r["doc_id"]] = max(r["quality"], quality.get(r["doc_id"], 0))
    lang = {(r["doc_id"], r["text"]): r["lang"] or "" for r in docs.select("doc_id", "text", "lang").collect()}

    def shares(r):
        pairs = (("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"),
                 ("n_upper", "n_letters"), ("n_long_words", "n_words"))
        return [-(-1000 * r[a] // max(1, r[b])) for a, b in pairs]

    lays = {r[0] for r in docs.filter(rules._lays_grid(F.col("doc_id"))).select("doc_id").collect()}
    top = {}
    for r in rows:
        if r["doc_id"] in quality and not r["base_failed"]:
            key = r["doc_id"], r["stratum"]
            top[key] = list(map(max, top.get(key, [0] * 5), shares(r)))
    good = [x for (i, _), x in top.items() if i in lays and quality[i]]
    assert good and len(good) < len([i for i, _ in top if quality[i]])
    grid = [[min(c for c in {x[k] for x in good} if sum(x[k] > c for x in good) <= step * len(good)) for k in range(5)]
            for step in rules.STEPS]

    def first(x):
        return next((k for k, cuts in enumerate(grid, 1) if any(a > c for a, c in zip(x, cuts))), len(grid) + 1)

    held = defaultdict(lambda: ([], []))
    for (i, stratum), x in top.items():
        if i not in lays:
            held[stratum][quality[i]].append(first(x))
    levels = {}
    for s, (bad, fine) in held.items():
        by = [[sum(x <= k for x in f) for k in range(1, len(grid) + 1)] for f in (bad, fine)]
        strictest = rules.select_level(len(fine), by[1], 0.02, 0.05 / len(held))
        levels[s] = strictest, rules.useful_level(strictest, by[0])
    assert {r["stratum"] for r in rows} >= set(lang.values())
    for r in rows:
        assert (r["certified"], r["level"]) == levels.get(r["stratum"], (0, 0))
        assert r["kept"] == (not r["base_failed"] and first(shares(r)) > r["level"])


def test_the_bound_stops_the_grid_on_driver_rows(spark):
    """Every stratum with cutoffs stops before the grid's end, and the good
    documents that it rejects stay few in the half that did not choose."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = rules.judge(docs, labels).cache()
    levels = {r[0]: (r[1], r[2]) for r in judged.select("stratum", "certified", "level").distinct().collect()}
    assert any(0 < c < len(rules.STEPS) for c, _ in levels.values())
    assert all(k <= c < len(rules.STEPS) for c, k in levels.values())
    seen = judged.filter("not base_failed").join(labels, "doc_id").groupBy("stratum", "quality").agg(
        F.count(F.when(F.col("kept"), 1)).alias("kept"), F.count(F.lit(1)).alias("n")).collect()
    for r in seen:
        assert r["quality"] != 1 or r["kept"] >= 0.98 * r["n"]
        assert r["quality"] != 0 or not levels[r["stratum"]][1] or r["kept"] < r["n"]


def test_rules_use_a_certified_level(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}%%%%" for i in range(60))
    rows = [(i, clean, "en") for i in range(1000)] + [(i, junk, "en") for i in range(2000, 2060)] + [(3000, junk, "fr"), (3001, junk, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1000)] + [(i, 0) for i in range(2000, 2060)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in rules.judge(docs, labels).filter("kept").collect()}
    assert kept == {*range(1000), 3000, 3001}          # no labels in fr or null: no cutoffs there
    assert {r["doc_id"] for r in rules.keep_good(docs, labels).collect()} == kept
    few = rules.judge(docs, labels.filter("doc_id < 40 or doc_id >= 2000"))
    assert few.filter("doc_id between 2000 and 2059 and kept").count() == 60


def test_grid_of_cutoffs(monkeypatch):
    monkeypatch.setattr(rules, "STEPS", (0.0, 0.1, 0.5, 1.0))
    assert rules.lay_grid([{0: 5, 3: 4, 9: 1}]) == [[9], [3], [0], [0]]
    assert rules.lay_grid([{0: 1}, {}]) == [] and rules.lay_grid([{0: 7}, {2: 7}]) == [[0, 2]] * 4


def test_exact_binomial_bound():
    assert abs(rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** 0.01)) < 1e-9
    assert rules.upper_bound(5, 5, 0.05) == 1.0
    p = rules.upper_bound(3, 50, 0.025)
    from math import comb
    assert abs(sum(comb(50, k) * p ** k * (1 - p) ** (50 - k) for k in range(4)) - 0.025) < 1e-6
    assert rules.select_level(0, [0, 0], 0.05, 0.05) == 0
    assert rules.select_level(1000, [0, 1, 900], 0.05, 0.05) == 2
    assert rules.useful_level(3, [5, 9, 9, 20]) == 2 and rules.useful_level(2, [0, 0, 1]) == 0
    assert rules.useful_level(0, [5, 9]) == 0


def test_pipeline_stage_keeps_all_columns(docs, labels):
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = bag((r["doc_id"], r["n_words"]) for r in rules.judge(docs, labels).filter("kept").collect())
    assert sum(want.values()) == kept.count()


# 3 factorisation machine

def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = factorisation.Model(0.3, rng.normal(size=factorisation.DIM), rng.normal(size=(factorisation.DIM, 8)), 0, 1)
    at, x = np.array([1, 5, 9, 700]), np.array([0.5, -1, 2, 0.1])
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(m.raw(at, x) - (0.3 + m.linear[at] @ x + pairs)) < 1e-9


def test_factorisation_machine_scores(docs, labels):
    model = factorisation.train(docs, labels)
    rows = factorisation.score(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    truth = {r["doc_id"]: r["quality"] for r in labels.filter("quality is not null").collect()}
    test = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    bad, good = [s for y, s in test if y == 0], [s for y, s in test if y == 1]
    assert not bad or not good or np.mean([g > b for g in good for b in bad]) > 0.9


def test_factorisation_machine_without_labels(docs, labels, empty):
    model = factorisation.train(docs, labels.limit(0))
    assert {r["score"] for r in factorisation.score(docs, model).collect()} == {0.5}
    assert factorisation.score(empty, model).count() == 0


def test_word_shape_is_of_the_whole_word():
    assert factorisation.shape("a" * 64 + "9B-x") == "a9A-a" != factorisation.shape("a" * 64 + "--")


# 4 exact dedup

def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("collide", [False, True])
def test_exact_groups(docs, plain, collide):
    hash_fn = (lambda data: len(data) % 3) if collide else fingerprints.fingerprint
    groups = defaultdict(list)
    for i, t in plain:
        groups[lower(t)].append(i)
    rows = fingerprints.exact_groups(docs, hash_fn=hash_fn).collect()
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i, n in Counter(ids).items():
            for k in range(n):
                want[i, keep, len(ids), i == keep and k == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert bag(rows) == want
    kept = fingerprints.keep_one(docs, hash_fn=hash_fn)
    assert kept.columns == docs.columns
    assert bag((r["doc_id"], lower(r["text"])) for r in kept.collect()) == bag(
        (max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items())


def test_fingerprints_compose():
    data = bytes(np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8))
    whole = fingerprints.compose(fingerprints.chunk_hashes(data))
    slow = [0, 0]
    for c in data[:5000]:
        slow = [(h * b + c) % p for h, b, p in zip(slow, fingerprints.BASES, fingerprints.PRIMES)]
    assert fingerprints.compose(fingerprints.chunk_hashes(data[:5000], 64))[:2] == tuple(slow)
    for cut in (1, 65_536, 100_001):
        parts = [fingerprints.compose(fingerprints.chunk_hashes(x, c)) for x, c in ((data[:cut], 1 << 10), (data[cut:], 1 << 16))]
        assert fingerprints.compose(parts) == whole
    assert fingerprints.compose([]) == (0, 0, 0)


# 5 license scan

def test_license_scan(docs, plain):
    def grams(body):
        w = re.findall(r"[^\W_]+", body.lower())
        return {f"{a} {b}" for a, b in zip(w, w[1:])}

    sets = [(n, grams(t)) for n, t in license_scan.TEMPLATES]
    want = Counter()
    for i, t in plain:
        hits = []
        if t is not None:
            units = [("line", k, x) for k, x in enumerate(t.split("\n"))]
            units += [("paragraph", k, x) for k, x in enumerate(re.split(r"\n[ \t\r]*\n", t)) if "\n" in x]
            for kind, k, body in units:
                g = grams(body)
                hits += [(kind, k, n, len(g & s), len(g), len(s)) for n, s in sets if 2 * len(g & s) >= 0.8 * (len(g) + len(s)) and g]
        want[i, tuple(hits)] += 1
    rows = license_scan.scan_licenses(docs).collect()
    assert Counter((r["doc_id"], tuple(tuple(h) for h in r["hits"])) for r in rows) == want
    assert sum(bool(h) for _, h in want) > 2


def test_license_anchors_are_needed_for_a_match():
    words = license_scan.anchors(license_scan.TEMPLATES, 80)
    for name, t in license_scan.TEMPLATES:
        g = license_scan.bigrams(t)
        free = [x for x in g if not set(x.split()) & set(words)]
        assert len(free) < 80 * len(g) / 120, name


def test_license_scan_runs_without_python(docs):
    plan = license_scan.scan_licenses(docs.sparkSession.read.parquet(f"{SF001}/documents.parquet"))
    assert not re.search("Python|Arrow|Exchange", plan._jdf.queryExecution().executedPlan().toString())


GPL2 = ["This program is free software; you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
        "the Free Software Foundation; either version 2 of the License, or", "(at your option) any later version."]


def test_license_notices_within_other_words(spark):
    header = "/*\n * Copyright (C) 2020 Foo\n *\n * " + "\n * ".join(GPL2) + "\n *\n * This program is distributed in the hope\n */\nint x;"
    prose = "the end of the road is far and nothing there is for you "
    cases = [("This project is released under the MIT License.", {"mit"}), ("Copyright (c) 2020 Foo Inc. All rights reserved.", {"all-rights-reserved"}),
             ("Licensed under the MIT License.", {"mit"}), (header, {"gpl-2.0", "gpl-3.0"}),
             (prose * 50 + " ".join(GPL2) + " " + prose * 50, {"gpl-2.0", "gpl-3.0"}),
             ("Licensed under the Apache License, Version 2.0. All rights reserved.", {"apache-2.0", "all-rights-reserved"}),
             ("x " * 9 + "released under the MIT License. " * 3, {"mit"}), ("licensed under the terms of the MIT License", {"mit"}),
             ("it is licensed under the terms of the contract, under the public license", set()), (prose * 9, set()), ("under the license, all of it", set())]
    got = license_scan.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    found = {r["doc_id"]: r["hits"] for r in got}
    for i, (t, want) in enumerate(cases):
        assert {h["license"] for h in found[i]} >= want and bool(found[i]) == bool(want), t
    assert ("window", 3, "mit", 4, 4, 4) in [tuple(h) for h in found[0]]
    assert sorted(h["number"] for h in found[6] if h["shared"] == 4 == h["unit_size"]) == [9, 14, 19]


def test_license_windows_random_texts(spark):
    """A license is reported where, and only where, a run of words matches."""
    rng = np.random.default_rng(7)
    known = [(n, license_scan.bigrams(t)) for n, t in (*license_scan.TEMPLATES, *license_scan.WORDINGS)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(3):
            name, grams = known[rng.integers(len(known))]
            notice = [grams[0].split()[0]] + [g.split()[1] for g in grams]
            words += ["x"] * rng.integers(0, 4) + [w for w in notice if rng.random() > 0.06]
        texts.append("".join(w + [" ", "\n", " * "][rng.integers(3)] for w in words))
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        w = re.findall(r"[^\W_]+", texts[r["doc_id"]].lower())
        g, want = [f"{a} {b}" for a, b in zip(w, w[1:])], set()
        for name, t in known:
            runs = (set(g[i:j]) for i in range(len(g)) for j in range(i + 1, min(len(g), i + len(t) * 3 // 2) + 1))
            if any(10 * len(x & set(t)) >= 4 * (len(x) + len(t)) for x in runs):
                want.add(name)
        assert {h["license"] for h in r["hits"]} == want, texts[r["doc_id"]]


# 6 secret scan

def slow_base(text):
    text = text or ""
    found = [(m.start(), m.end(), "assign") for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_secret_base_spans(docs, plain):
    rows = secret_scan.scan_secrets(docs).collect()
    got = Counter((r["doc_id"], tuple((s["start"], s["end"], s["kind"]) for s in r["spans"] if s["kind"] in secret_scan.BASE_KINDS))
                  for r in rows)
    assert got == Counter((i, tuple(slow_base(t))) for i, t in plain)
    assert any(s for _, s in got)


def test_secret_scan_random_texts():
    rng = np.random.default_rng(5)
    parts = ["token", "api_key", "APIKEY", "secret", "passwd", "PassWord", "AKIA", "akia", "é", "K", "ſ", " ", "  ", ":", "=", "'", '"',
             "abcdef0123456789", "A1B2C3D4E5F6", ".", "-", "\n", "x"]
    scan = secret_scan.Scanner().spans
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert [s for s in scan(text) if s[2] in secret_scan.BASE_KINDS] == slow_base(text), text


def test_secret_checksums(spark):
    body = "aZ" * 15
    good, bad = f"ghp_{body}{secret_scan.base62_crc(body)}", f"ghp_{body}000000"
    jwt = "eyJhbGciOiJub25lIn0.eyJzdWIiOiIxIn0.abc"
    text = f"é {good} {bad} npm_{body}{secret_scan.base62_crc(body)} {jwt} eyJxx.eyJyy.z card: 4111 1111 1111 1111 card 4111111111111112"
    kinds = Counter(k for _, _, k in secret_scan.Scanner().spans(text))
    assert kinds == {"github": 1, "npm": 1, "jwt": 1, "card": 1}
    masked = secret_scan.mask_secrets(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")).collect()
    assert masked[0]["text"].startswith(f"é [SECRET] {bad} [SECRET] [SECRET] eyJxx") and masked[1]["text"] is None
    assert masked[2]["text"] == "plain"


def test_private_keys_are_masked_whole(spark):
    import base64
    raw = base64.b64encode(np.random.default_rng(11).bytes(582)).decode()
    lines = [raw[i:i + 64] for i in range(0, len(raw), 64)]
    assert len(lines[-1]) < 16

    def pem(sep, kind="RSA ", fields="", end=True, lines=lines):
        return sep.join([f"-----BEGIN {kind}PRIVATE KEY-----", *fields.split("|"), *lines, *[f"-----END {kind}PRIVATE KEY-----"] * end])

    dek = "Proc-Type: 4,ENCRYPTED|DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF|"
    keys = [pem(s, k, f, e) for s in ("\n", "\r\n", " ", "\\n", "\n> ", "\n# ", "\n * ") for k in ("", "RSA ", "EC ") for f in ("", dek) for e in (True, False)]
    keys += [pem("\n", end=False, lines=lines[:3] + [lines[3][:n]]) for n in (1, 9, 30)]      # cut off
    keys += [pem("\n", end=False) + "\n\n" + pem("\n", "EC "), "secret: " + pem("\n")]
    texts = [f"é before {k}\nand after it" for k in keys] + keys
    out = secret_scan.mask_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in out:
        assert not any(raw[k:k + 8] in t for k in range(len(raw) - 7)) and "-----" not in t and "DEK" not in t and "==" not in t, (texts[i], t)
        assert i >= len(keys) or t.startswith("é before ") and t.endswith("\nand after it"), (texts[i], t)
    scan = secret_scan.Scanner().spans
    whole = pem("\n")
    assert (3, 3 + len(whole), "private_key") in scan("é: " + whole + " and more")
    bare = "-----BEGIN PRIVATE KEY-----"
    assert scan(f"a line {bare} marks the start of a key") == [(7, 7 + len(bare), "private_key")]


# 7 n-gram join

def grams5(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_join(rows, threshold=0.8):
    sets = [grams5(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(i)
    out = Counter()
    for group in members.values():
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        for i in group:
            out[rows[i][0], least, links[i], len(group)] += 1
    return out


def test_ngram_join(docs, plain):
    assert bag(ngram_join.jaccard_join(docs).collect()) == slow_join(plain)
    kept = ngram_join.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    want = slow_join(plain)
    assert kept.filter("length(trim(text)) > 0 and doc_id is not null").count() <= len({c for _, c, *_ in want})


def test_ngram_join_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 16)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, "some words of a quite different text number %d that stands alone here" % i) for i in range(20)]
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 6)):
            w[k] = f"x{i}_{k}"
        rows.append((100 + i, " ".join(w)))
    rows += [(500 + i, rows[40][1].upper()) for i in range(5)]
    got = bag(ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == slow_join(rows)


def test_ngram_hashes_and_signatures(plain):
    texts = [t for _, t in plain] + ["a b", " a  b ", "A B", "a b c d e", "a b c d e f", "x " * 3000]
    made = list(ngram_join.ngram_hashes(pa.array(texts), 5))
    assert [len(h) for h in made] == [len(grams5(t)) for t in texts]
    keys = defaultdict(set)
    for t, h in zip(texts, made):
        keys[ngram_join.set_key(h)].add(grams5(t))
    assert all(len(v) == 1 for v in keys.values()) and len(keys) == len({grams5(t) for t in texts})
    # rows of a band agree about as often as the sets are similar
    rng = np.random.default_rng(0)
    sign = ngram_join.Signer(1000, 1)
    for overlap in (0.3, 0.6, 0.8, 0.95):
        shared = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        own = int(500 * (1 / overlap - 1) / 2)
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, own, dtype=np.uint64)]) for _ in "ab")
        assert abs(np.mean(sign(a) == sign(b)) - overlap) < 0.07


def test_banding_reaches_its_recall():
    bands, per = ngram_join.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8 ** per) ** bands >= 0.9999 and bands * per <= ngram_join.MAX_HASHES


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200), (50, 51), (51, 50)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in (100, 101, 102)}, 200: 200, 50: 50, 51: 50}


# 8 language identification

def test_language_identification(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()]
    truth = {i: re.search(r'<html[^>]*lang="(\w+)', h)[1] for i, _, h in rows}
    blind = [(i, u, re.sub(r'<html lang="\w+"', "<html", h) if i % 2 else h) for i, u, h in rows]
    blind += [(9001, None, None), (9002, "", ""), (9003, "not an address", "<html lang=DE-at>x</html>"), (None, blind[0][1], None)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in blind], "page_id long, url string, html string, host string, q int")
    documents = spark.read.parquet(f"{SF001}/documents.parquet")
    got = language_id.identify(pages, documents).collect()
    assert len(got) == len(blind) and all(r["lang"] in ("de", "en", "es", "fr") and 0.2 < r["score"] <= 1 for r in got)
    right = [r["lang"] == truth[r["page_id"]] for r in got if r["page_id"] in truth]
    assert np.mean(right) >= 0.98
    assert {r["page_id"]: r["declared"] for r in got}[9003] == "de"
    assert language_id.identify(pages.limit(0), documents).count() == 0
    nothing = language_id.identify(pages, documents.limit(0)).collect()
    assert len(nothing) == len(blind) and {r["lang"] for r in nothing} == {None}


def test_language_with_few_documents_is_fitted(spark):
    rows = [(i, "the road and the house", "en") for i in range(3000)] + [(5000 + i, "talo ja tie", "fi") for i in range(2)]
    rows += [(7000, "la casa", "es")] * 500 + [(None, "das Haus", "de"), (None, "no language", None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logs = language_id.fit(documents, 5)
    assert langs == ["de", "en", "es", "fi"]
    talo = language_id.trigram_bins("talo")
    assert logs[:, talo].sum(axis=1).argmax() == 3
    hashes = {h for h, in documents.filter("lang = 'en'").select(F.xxhash64("doc_id")).collect()}
    assert len(hashes) == 3000                                         # five of them are counted
    counts = np.bincount(language_id.trigram_bins("the road and the house"), minlength=language_id.BINS) * 5 + 0.5
    assert np.allclose(logs[1], np.log(counts / counts.sum()))


def test_language_evidence_is_counted_exactly(spark, monkeypatch):
    def estimate(*_):
        raise AssertionError("an estimate enters the scores")
    monkeypatch.setattr(language_id.F, "approx_count_distinct", estimate)
    pages = spark.createDataFrame([(1, "http://a.de/x", "<html lang=de>das Haus</html>")], "page_id long, url string, html string")
    documents = spark.createDataFrame([(1, "das Haus", "de"), (2, "the house", "en")], "doc_id long, text string, lang string")
    assert [r["lang"] for r in language_id.identify(pages, documents).collect()] == ["de"]


# 9 and 10 tokens

@pytest.fixture(scope="module")
def pieces():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts(docs, plain, pieces, monkeypatch):
    from tillbook.llm import chunk_table
    monkeypatch.setattr(chunk_table, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(chunk_table, "LEAST_BUCKETS", 13)
    got = token_counts.count_tokens(docs, queries.PIECE_MODEL).collect()
    assert bag(got) == bag((i, len((t or "").encode()), len(pieces.encode(t or ""))) for i, t in plain)


def test_encode_decode(docs, plain, pieces):
    got = sentencepieces.encode_decode(docs, queries.PIECE_MODEL).collect()
    want = Counter()
    for i, t in plain:
        ids = [pieces.bos_id(), *pieces.encode(t or ""), pieces.eos_id()]
        want[i, struct.pack(f"<{len(ids)}I", *ids), pieces.decode(ids)] += 1
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == want


def test_chunk_buckets_grow_with_the_dictionaries(spark, docs, plain, pieces, monkeypatch):
    from tillbook.llm import chunk_table
    monkeypatch.setattr(chunk_table, "LEAST_BUCKETS", 1)
    block_rows = chunk_table.blocks(docs, "doc_id", "text", frequencies=True)
    assert chunk_table.spread(block_rows) == (4, 1)
    total = block_rows.agg(F.sum(F.octet_length("words"))).first()[0]
    monkeypatch.setattr(chunk_table, "TASK_BYTES", total // 50)
    buckets, tasks = chunk_table.spread(block_rows)
    assert tasks in (50, 51) and buckets == 4 * tasks
    asked = chunk_table.segmented(block_rows, queries.PIECE_MODEL, False, buckets, tasks)
    assert asked.rdd.getNumPartitions() == tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = asked.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("bucket").alias("n"))
    assert read.agg(F.max("n")).first()[0] <= 16 and read.count() > tasks / 2
    got = token_counts.count_tokens(docs, queries.PIECE_MODEL).collect()
    assert bag(got) == bag((i, len((t or "").encode()), len(pieces.encode(t or ""))) for i, t in plain)
    got = sentencepieces.encode_decode(docs, queries.PIECE_MODEL).select("ids").collect()
    assert Counter(len(r["ids"]) // 4 - 2 for r in got) == Counter(len(pieces.encode(t or "")) for _, t in plain)
    none = docs.filter("text is null")
    assert [r["n_tokens"] for r in token_counts.count_tokens(none, queries.PIECE_MODEL).collect()] == [0] * none.count()


def test_chunks_random_texts(pieces):
    from tillbook.llm import chunk_table
    _, bare = chunk_table.processors(queries.PIECE_MODEL)
    rng = np.random.default_rng(9)
    parts = list(" ▁\n\t\r.,é1日a-'") + ["the", "  ", "<s>", "<0x0A>", "\x00", "▁▁▁", "...", "://", "n't", " (", "e.g."]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(0, 20)))
        assert [i for c in chunk_table.chunks(t) for i in bare.encode(c)] == pieces.encode(t)


def test_pipeline_stages(spark, docs, labels, tmp_path):
    """Every stage on tricky rows: same columns, whole effect, clean rows kept."""
    import corpus_pipeline as cp
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.schema == now.schema, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append(now.select("doc_id", "text").collect())
    assert all(len((t or "").split()) >= 50 for _, t in seen[0])
    assert len({lower(t) for _, t in seen[1]}) == len(seen[1])
    assert all(n == 0 for (_, _, n, _), k in slow_join([tuple(r) for r in seen[2]]).items())
    scan = secret_scan.Scanner().spans
    assert len(seen[3]) == len(seen[2]) and not any(scan(t) for _, t in seen[3])
    before = dict(map(tuple, seen[2]))
    assert all(t == before[i] for i, t in seen[3] if not scan(before[i]))
    packed = cp.STAGES[-1][1](spark, now, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(seen[3])


def test_empty_tables(empty, labels):
    assert packing.pack(empty, queries.WORD_TOKENIZER).count() == 0
    assert rules.judge(empty, labels).count() == 0 and rules.keep_good(empty, labels.limit(0)).count() == 0
    assert fingerprints.exact_groups(empty).count() == 0 and fingerprints.keep_one(empty).count() == 0
    assert license_scan.scan_licenses(empty).count() == 0
    assert secret_scan.scan_secrets(empty).count() == 0 and secret_scan.mask_secrets(empty).count() == 0
    assert ngram_join.jaccard_join(empty).count() == 0 and ngram_join.keep_one_per_class(empty).count() == 0
    assert token_counts.count_tokens(empty, queries.PIECE_MODEL).count() == 0
    assert sentencepieces.encode_decode(empty, queries.PIECE_MODEL).count() == 0
