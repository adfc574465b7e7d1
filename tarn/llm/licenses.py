"""Licence scans: texts against licence templates by the Dice coefficient over word bigrams, with size bounds pruning templates.

A document's whole text, each of its lines and windows of a template's number of words are units. Units and templates are lower-cased, and their words are runs of letters and
digits; a unit of n distinct bigrams can only reach the threshold t with templates of between n t / (2 - t) and n (2 - t) / t, so
others aren't compared. Of a template of m bigrams a window must hold m t / (2 - t), so only documents with as many of them have windows,
and only those windows are compared that may hold as many. Texts without any of the words that a match must have aren't split at all. All work is in SQL expressions over one pass; the templates are in the plan.
"""

from __future__ import annotations

import math
import re
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import texts
from tarn.llm.license_texts import LICENSES

#: Templates: public licence notices and short licences. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
THRESHOLD = 0.8


#: The notices, then the complete texts.
ALL_TEMPLATES = (*TEMPLATES, *LICENSES)
#: From so many bigrams on a template is only looked for in documents of enough words. Results don't depend on it.
LONG = 400


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, sorted."""
    return sorted({" ".join(p) for p in pairwise(template_words(text))})


#: From so many deciding bigrams on, words that cover them are looked for in place of the bigrams themselves.
FEW = 12


def deciding(text: str, threshold: float) -> list[tuple[str, ...]]:
    """Alternatives, each a list of words, of which a text must hold one whole to match a template anywhere.

    A match holds at least c of the template's m bigrams, whatever the unit, so it lacks m - c at most: of any m - c + 1 bigrams it holds
    one. These are chosen by their longest words, which are seldom in other texts; where they are many, the fewest long words that
    cover as many bigrams take their place.
    """
    grams = [tuple(g.split(" ")) for g in template_bigrams(text)]
    m = len(grams)
    many = m - math.ceil(m * threshold / (2 - threshold) - 1e-9) + 1
    best = sorted(grams, key=lambda g: (-max(map(len, g)), -min(map(len, g)), g))[:many]
    if many <= FEW:
        return best
    left, chosen, covered = set(grams), [], 0
    while covered < many:
        counts: dict[str, int] = {}
        for g in left:
            for w in set(g):
                counts[w] = counts.get(w, 0) + 1
        # Long words first; a word of under six letters only where no other is left.
        word = max(counts, key=lambda w: (len(w) > 5, counts[w], len(w), w))
        hit = {g for g in left if word in g}
        left -= hit
        covered += len(hit)
        chosen.append((word,))
    return chosen


def least_chars(text: str, threshold: float) -> int:
    """Characters that a text must have to match a template: those of the first words of as few and as short bigrams as a match holds, and what parts them."""
    firsts = sorted(len(g.split(" ")[0]) + 1 for g in template_bigrams(text))
    return sum(firsts[: math.ceil(len(firsts) * threshold / (2 - threshold) - 1e-9)])


def may_match(text: Column, templates, threshold: float) -> Column:
    """Whether a lower-cased text is long enough for any template and holds what its match must hold. It only saves work: what it passes over matches nothing."""
    every = F.lit(False)
    for _, t in templates:
        wanted = deciding(t, threshold)
        single = sorted({w[0] for w in wanted if len(set(w)) == 1})
        # A pair with a word that is looked for alone says no more than that word.
        pairs = sorted(sorted(w, key=lambda x: (-len(x), x)) for w in wanted if len(set(w)) > 1 and not set(single) & set(w))
        has = F.lit(False)
        for w in single:
            has = has | F.contains(text, F.lit(w))
        for long_, short in pairs:
            has = has | (F.contains(text, F.lit(long_)) & F.contains(text, F.lit(short)))
        every = every | ((F.length(text) >= least_chars(t, threshold)) & has)
    return every


def _listed(grams: list[str]) -> Column:
    """Bigrams as one value of the plan."""
    return F.split(F.lit("\n".join(grams)), "\n")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _pairs(words: Column) -> Column:
    """All bigrams of an array of words, in their order."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of words."""
    return F.array_distinct(_pairs(words))


def _hit(grams: Column, t: Column, unit: Column) -> Column:
    dice = 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["m"])
    return F.struct((-dice).alias("minus"), t["template"].alias("template"), unit.alias("unit"), t["license"].alias("license"))


def _window_hits(pairs: Column, t: Column, lines: Column) -> Column:
    """A template against the windows of its number of words that begin with one of its bigrams and may hold enough of them."""

    def of(at: Column) -> Column:
        last = F.size(at) - t["need"] + 1
        begins = F.filter(F.slice(F.sequence(F.lit(1), F.greatest(F.size(at), F.lit(1))), 1, F.greatest(last, F.lit(0))), lambda j: F.get(at, j + t["need"] - 2) - F.get(at, j - 1) <= t["words"] - 2)
        return F.transform(begins, lambda j: _hit(F.array_distinct(F.slice(pairs, F.get(at, j - 1), t["words"] - 1)), t, lines + F.get(at, j - 1)))

    where = F.filter(F.transform(pairs, lambda p, i: F.when(F.array_contains(t["grams"], p), i + 1)), lambda i: i.isNotNull())
    return _let(where, of)


def scan_licenses(docs: DataFrame, *, templates=ALL_TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, license, template, dice, unit, found``.

    The best match of any unit at ``threshold`` or more: of equal Dice coefficients the earliest template, then the earliest unit (0: the
    whole text, 1 on: its lines, then its windows by their first word). ``found`` lists the distinct licences of all matches, sorted, comma-joined.
    Without a match ``license`` and ``found`` are empty, ``template`` and ``unit`` -1 and ``dice`` 0. A null text is an empty one and matches
    nothing, as do units of under two words. Repeated rows and null ids are kept; other columns are not used. One pass, no shuffle.
    """
    made = [(name, template_bigrams(text), len(template_words(text))) for name, text in templates]
    sizes = [len(b) for _, b, _ in made]
    need = [math.ceil(m * threshold / (2 - threshold) - 1e-9) for m in sizes]
    low, high = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    may = may_match(F.col("__lower"), templates, threshold)
    units = F.when(may, F.concat(F.array(F.col("text")), F.split(F.col("text"), "\n"))).otherwise(F.expr("cast(array() as array<string>)"))
    words = F.transform(units, lambda u, i: F.struct(i.alias("unit"), F.filter(F.split(F.lower(u), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words")))
    # n distinct bigrams take n + 1 words at least.
    grams = F.transform(F.filter("__words", lambda u: F.size(u["words"]) - 1 >= low), lambda u: F.struct(u["unit"], _bigrams(u["words"]).alias("grams")))
    kept = F.filter(grams, lambda u: F.size(u["grams"]).between(low, high))
    table = F.array(
        *(
            F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(len(b)).alias("m"), F.lit(n).alias("words"), F.lit(c).alias("need"), _listed(b).alias("grams"))
            for k, ((name, b, n), c) in enumerate(zip(made, need, strict=True))
        )
    )

    def against(u: Column) -> Column:
        n = F.size(u["grams"])
        near = F.filter(table, lambda t: (t["m"] >= n * threshold / (2 - threshold)) & (t["m"] <= n * (2 - threshold) / threshold))
        return F.transform(near, lambda t: _hit(u["grams"], t, u["unit"]))

    every = sorted({g for _, b, _ in made for g in b})
    short = sorted({g for _, b, _ in made if len(b) < LONG for g in b}) or every
    least = min((c for c, m in zip(need, sizes, strict=True) if m >= LONG), default=0)
    pairs = _pairs(F.coalesce(F.get("__words", F.lit(0))["words"], F.expr("cast(array() as array<string>)")))

    def in_windows(pairs: Column) -> Column:
        shared = F.array_intersect(pairs, F.when(F.size(pairs) >= least, _listed(every)).otherwise(_listed(short)))
        near = _let(shared, lambda s: F.filter(table, lambda t: (F.size(s) >= t["need"]) & (F.size(F.array_intersect(s, t["grams"])) >= t["need"])))
        return F.flatten(F.transform(near, lambda t: _window_hits(pairs, t, F.size("__words") - 1)))

    every_hit = F.concat(F.flatten(F.transform("__kept", against)), _let(pairs, in_windows))
    hits = F.when(F.size("__words") > 0, F.filter(every_hit, lambda h: -h["minus"] >= threshold))
    out = texts(docs).withColumn("__lower", F.lower("text")).withColumn("__words", words).withColumn("__kept", kept).withColumn("__hits", hits).withColumn("__best", F.array_min("__hits"))
    found = F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["license"]))), ","), F.lit(""))
    best = lambda name, none: F.coalesce(F.col(f"__best.{name}"), F.lit(none)).alias(name)
    return out.select("doc_id", best("license", ""), best("template", -1), F.coalesce(-F.col("__best.minus"), F.lit(0.0)).alias("dice"), best("unit", -1), found.alias("found"))


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan_licenses`` over ``documents``."""
    rows = ", ".join(f"({k}, '{name}', [{', '.join(repr(b) for b in template_bigrams(text))}])" for k, (name, text) in enumerate(templates))
    return f"""
    WITH templates(template, license, grams) AS (VALUES {rows}),
    docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    units AS (SELECT r, 0 AS unit, text AS u FROM docs
              UNION ALL SELECT r, unnest(range(1, len(s) + 1))::INTEGER, unnest(s) FROM (SELECT r, string_split(text, chr(10)) AS s FROM docs)),
    words AS (SELECT r, unit, list_filter(regexp_split_to_array(lower(u), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM units),
    grams AS (SELECT r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
    hits AS (SELECT r, unit, template, license, 2.0::DOUBLE * len(list_intersect(g, t.grams)) / (len(g) + len(t.grams)) AS dice
             FROM grams JOIN templates t ON len(t.grams) >= len(g) * {threshold} / (2 - {threshold}) AND len(t.grams) <= len(g) * (2 - {threshold}) / {threshold}),
    good AS (SELECT * FROM hits WHERE dice >= {threshold}),
    best AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, template, unit) = 1),
    every AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS found FROM good GROUP BY r)
    SELECT doc_id, coalesce(license, '') AS license, coalesce(template, -1) AS template, coalesce(dice, 0) AS dice, coalesce(unit, -1) AS unit, coalesce(found, '') AS found
    FROM docs LEFT JOIN best USING (r) LEFT JOIN every USING (r)"""
