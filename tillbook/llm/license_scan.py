"""License scans: units of a text against license templates by Dice
coefficient over word bigrams.  Built-in SQL functions only.

Units are lines and paragraphs (text between blank lines).  A unit's words
are its lower-cased runs of letters and digits, its set the distinct pairs
of neighbouring words.  ``Dice(U, T) = 2|U and T| / (|U| + |T|) >= tau`` needs
``|T|`` between ``tau/(2-tau) |U|`` and ``(2-tau)/tau |U|``; templates out of
these size bounds are not compared.

It also needs ``|U and T| >= tau/(2-tau) |T|``.  So if more than the rest of a
template's bigrams hold one of some *anchor* words, every match holds an
anchor.  ``anchors`` picks such words from the templates; texts and units
without any are passed over with plain substring tests.  The scan is a
projection: no shuffle, no group, and templates are literals in the plan.

A notice that shares its line and paragraph with other words is a *window*: a
run of a text's words, whatever breaks or comment markers lie between them,
with ``Dice >= tau`` to a template.  Only windows that begin and end with a
bigram of the template are compared, as others have a better one within them,
and of up to ``(2-tau)/tau |T|`` bigrams.  They start where the next
``tau/(2-tau) |T|`` bigrams of the template lie within that length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import id_text

# License id and notice text
TEMPLATES = (
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:"),
    ("bsd", "Released under the BSD License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

# Short wordings, looked for as windows beside TEMPLATES; what
# they share with other licenses' notices stays below the threshold
WORDINGS = (
    ("agpl-3.0", "Licensed under the GNU Affero General Public License."),
    ("apache-2.0", "Licensed under Apache 2.0."),
    ("bsd", "Licensed under the BSD License."),
    ("bsd", "Terms of the BSD License."),
    ("isc", "Licensed under the ISC License."),
    ("mit", "Licensed under MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Terms of the MIT License."),
    ("mpl-2.0", "Licensed under the Mozilla Public License."),
)

# Words too common in prose to look for first
COMMON = ("any", "and", "are", "far", "for", "may", "not", "that", "the", "this", "under", "version", "with",
          "without", "work", "you", "rights", "provided", "subject", "following", "possible", "either", "later")


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams in order of appearance."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors(templates, percent: int) -> list[str]:
    """Words of which every unit with ``Dice >= percent / 100`` to a template
    holds at least one: greedily, the word that completes most templates."""
    need = []                                  # bigrams to cover per template
    sets = [bigrams(t) for _, t in templates]
    for s in sets:
        least = -(-percent * len(s) // (200 - percent))       # of a match, shared at least
        need.append(len(s) - least + 1)
    chosen: list[str] = []
    left = [set(s) for s in sets]
    while any(len(s) - len(rest) < n for s, rest, n in zip(sets, left, need)):
        gain: dict[str, int] = {}
        for s, rest, n in zip(sets, left, need):
            open_ = n - (len(s) - len(rest))
            if open_ > 0:
                for w in {w for g in rest for w in g.split()}:
                    gain[w] = gain.get(w, 0) + min(open_, sum(w in g.split() for g in rest))
        word = max(gain, key=lambda w: (w not in COMMON, len(w) > 3, gain[w] * len(w), w))    # long words are rarer
        chosen.append(word)
        left = [{g for g in rest if word not in g.split()} for rest in left]
    return sorted(chosen)


def _any_of(text: Column, words: list[str]) -> Column:
    """Whether a lower-cased text may hold one of the words: long ones as
    substrings, short ones as whole words."""
    out, short = F.lit(False), [w for w in words if len(w) <= 3]
    for w in words:
        if w not in short:
            out = out | F.contains(text, F.lit(w))
    if short:
        out = out | F.rlike(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(short)})(?![\p{{L}}\p{{N}}])"))
    return out


def _literals(templates, percent: int) -> Column:
    """``license``, ``grams``, ``size``, ``need`` (bigrams that a match shares
    at least), ``longest`` (bigrams of a match at most) per template."""
    sizes = [len(bigrams(t)) for _, t in templates]
    return F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, bigrams(t))).alias("grams"),
                              F.lit(n).alias("size"), F.lit(-(-percent * n // (200 - percent))).alias("need"),
                              F.lit(n * (200 - percent) // percent).alias("longest"))
                     for (name, t), n in zip(templates, sizes)])


def _range(start: Column, stop: Column) -> Column:
    """Integers from ``start`` to ``stop`` - 1, none if there are none."""
    return F.when(start < stop, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, body) -> Column:
    """``body(value)``, an array, with ``value`` computed once."""
    return F.flatten(F.transform(F.array(value), body))


def _windows(s: Column, templates, percent: int) -> Column:
    """Hits in ``words`` that no hit line or paragraph of the same license
    holds: of windows that overlap, the one with the largest Dice, then the
    first."""
    words = s["words"]
    every = sorted({g for _, t in templates for g in bigrams(t)})
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                        lambda x, i: F.struct(i.alias("at"), F.concat_ws(" ", F.get(words, i), x).alias("gram")))

    def best_at(t: Column, places: Column, k: Column) -> Column:
        first = F.get(places, k)["at"]
        ends = F.filter(_range(k + t["need"] - 1, F.least(k + t["longest"], F.size(places))),
                        lambda e: F.get(places, e)["at"] - first < t["longest"])

        def compared(e: Column) -> Column:
            last = F.get(places, e)["at"]
            held = F.transform(F.sequence(first, last),
                               lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
            return F.struct(first.alias("first"), last.alias("last"),
                            F.size(F.array_intersect(held, t["grams"])).alias("shared"),
                            F.size(F.array_distinct(held)).alias("n"))

        def scored(c: Column) -> Column:
            return F.struct((c["shared"] / (c["n"] + t["size"])).alias("score"), (-c["last"]).alias("shorter"),
                            c["first"].alias("first"), c["last"].alias("last"), c["shared"].alias("shared"), c["n"].alias("n"))

        return F.array_max(F.transform(F.filter(F.transform(ends, compared), lambda c: (
            c["shared"] * 200 >= (c["n"] + t["size"]) * percent)), scored))

    def overlaps(a: Column, b: Column) -> Column:
        # a window's last word is one after its last bigram's first
        return (a["first"] <= b["last"] + 1) & (b["first"] <= a["last"] + 1)

    def around(found: Column, k: Column, t: Column) -> Column:
        """All that can overlap the window at ``k``: there is one per start."""
        low = F.greatest(k - t["longest"] - 1, F.lit(0))
        return F.slice(found, low + 1, k - low + t["longest"] + 2)

    def overlap_free(found: Column, t: Column) -> Column:
        """The best first, those that overlap it left out.  Windows better
        than all that overlap them are told locally; of the few that overlap
        none of these, runs of overlapping ones are taken one by one."""
        flagged = F.transform(found, lambda c, k: F.struct(
            c["score"], c["first"], c["last"], c["shared"], c["n"],
            (~F.exists(around(found, k, t), lambda o: overlaps(o, c) & (
                (o["score"] > c["score"]) | ((o["score"] == c["score"]) & (o["first"] < c["first"]))))).alias("top")))

        def chosen(run: Column) -> Column:
            ordered = F.array_sort(F.transform(run, lambda c: F.struct((-c["score"]).alias("worse"), c["first"], c.alias("c"))))
            return F.aggregate(ordered, F.slice(run, 1, 0), lambda kept, c: F.when(
                F.exists(kept, lambda o: overlaps(o, c["c"])), kept).otherwise(F.concat(kept, F.array(c["c"]))))

        def runs(rest: Column) -> Column:
            heads = F.filter(_range(F.lit(0), F.size(rest)), lambda k: ~F.exists(
                F.slice(rest, F.greatest(k - t["longest"] - 1, F.lit(0)) + 1, F.least(k, t["longest"] + 1)),
                lambda c: overlaps(c, F.get(rest, k))))
            return _let(heads, lambda h: F.flatten(F.transform(h, lambda k, j: chosen(
                F.slice(rest, k + 1, F.coalesce(F.get(h, j + 1), F.size(rest)) - k)))))

        return _let(flagged, lambda f: F.concat(F.filter(f, lambda c: c["top"]), _let(F.filter(
            f, lambda c, k: ~F.exists(around(f, k, t), lambda o: o["top"] & overlaps(o, c))), runs)))

    def of(t: Column, near: Column) -> Column:
        def known_there(c: Column) -> Column:
            out = F.lit(False)
            for at, hits in (("line_at", "line_hits"), ("block_at", "block_hits")):
                out = out | ((F.get(s[at], c["first"]) == F.get(s[at], c["last"] + 1)) & F.exists(
                    F.get(s[hits], F.get(s[at], c["first"])), lambda h: h["license"] == t["license"]))
            return out

        def search(places: Column) -> Column:
            starts = F.filter(_range(F.lit(0), F.size(places) - t["need"] + 1), lambda k: (
                F.get(places, k + t["need"] - 1)["at"] - F.get(places, k)["at"] < t["longest"])
                & (F.size(F.array_distinct(F.transform(F.slice(places, k + 1, t["longest"]), lambda p: p["gram"])))
                   >= t["need"]))
            found = F.filter(F.transform(starts, lambda k: best_at(t, places, k)), lambda c: c.isNotNull())
            return _let(found, lambda f: overlap_free(f, t))

        places = F.filter(near, lambda p: F.array_contains(t["grams"], p["gram"]))
        hits = F.filter(_let(places, search), lambda c: ~known_there(c))
        return F.transform(hits, lambda c: F.struct(
            F.lit("window").alias("unit"), c["first"].alias("number"), t["license"].alias("license"),
            c["shared"].alias("shared"), c["n"].alias("unit_size"), t["size"].alias("template_size")))

    return _let(F.filter(pairs, lambda p: p["gram"].isin(every)), lambda near: F.array_sort(
        F.flatten(F.transform(_literals(templates, percent), lambda t: of(t, near)))))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, percent: int = 80, id_col: str = "doc_id",
                  text_col: str = "text", wordings=WORDINGS) -> DataFrame:
    """``doc_id`` and ``hits`` of every row of ``docs``: an array of ``unit``
    (``line``, ``paragraph`` or ``window``), ``number`` (from 0 within its
    kind; of a window, of its first word in the text), ``license``,
    ``shared``, ``unit_size``, ``template_size`` (bigrams) with
    ``Dice >= percent / 100``, in order of unit, then template.

    Paragraphs of one line are reported as lines only, and a window only
    where its line or paragraph is no hit of the same license.  Windows are
    compared with ``wordings`` as well.  A null or empty text has no hits;
    units of fewer than two words match nothing; null ids and repeated rows
    are kept as they are; an empty table gives no rows; other columns are
    ignored; whole texts are read.
    """
    words = anchors((*templates, *wordings), percent)
    known = _literals(templates, percent)
    low = F.lower("text")
    lines = F.split(low, "\n", -1)
    blocks = F.split(low, "\n[ \t\r]*\n", -1)

    def worded(units: Column, kind: str, wanted) -> Column:
        return F.transform(units, lambda b, i: F.struct(
            F.lit(kind).alias("unit"), i.alias("number"), (wanted(b) & _any_of(b, words)).alias("compare"),
            F.filter(F.split(b, r"[^\p{L}\p{N}]+", -1), lambda x: x != "").alias("words")))

    def sized(units: Column) -> Column:
        # one step per array, so that no lambda computes an outer array again
        return F.transform(units, lambda s: F.struct(s["unit"], s["number"], F.when(
            s["compare"], F.array_distinct(F.transform(
                F.slice(s["words"], 2, F.greatest(F.size(s["words"]) - 1, F.lit(0))),
                lambda x, i: F.concat_ws(" ", F.get(s["words"], i), x))))
            .otherwise(F.array().cast("array<string>")).alias("grams")))

    def matches(s: Column) -> Column:
        n = F.size(s["grams"])
        fits = F.filter(known, lambda t: (t["size"] * (200 - percent) >= n * percent)
                        & (t["size"] * percent <= n * (200 - percent)))
        compared = F.transform(fits, lambda t: F.struct(
            s["unit"].alias("unit"), s["number"].alias("number"), t["license"].alias("license"),
            F.size(F.array_intersect(s["grams"], t["grams"])).alias("shared"),
            n.alias("unit_size"), t["size"].alias("template_size")))
        return F.filter(compared, lambda c: c["shared"] * 200 >= (c["unit_size"] + c["template_size"]) * percent)

    def number_of(units: Column) -> Column:
        """Of every word, the unit it is in."""
        return F.flatten(F.transform(units, lambda s: F.array_repeat(s["number"], F.size(s["words"]))))

    def hits(u: Column) -> Column:
        return _let(F.struct(F.flatten(F.transform(u["lines"], lambda s: s["words"])).alias("words"),
                             number_of(u["lines"]).alias("line_at"), number_of(u["blocks"]).alias("block_at"),
                             F.transform(sized(u["lines"]), matches).alias("line_hits"),
                             F.transform(sized(u["blocks"]), matches).alias("block_hits")),
                    lambda s: F.concat(F.flatten(s["line_hits"]), F.flatten(s["block_hits"]),
                                       _windows(s, (*templates, *wordings), percent)))

    rows = id_text(docs, id_col, text_col)
    both = F.struct(worded(lines, "line", lambda b: F.lit(True)).alias("lines"),
                    worded(blocks, "paragraph", lambda b: F.contains(b, F.lit("\n"))).alias("blocks"))
    kind = "array<struct<unit:string,number:int,license:string,shared:int,unit_size:int,template_size:int>>"
    return rows.select("doc_id", F.when(F.coalesce(_any_of(low, words), F.lit(False)), _let(both, hits))
                       .otherwise(F.array().cast(kind)).alias("hits"))
