"""License scans by the Dice coefficient over word bigrams, in DataFrame operations only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

# The notices that are looked for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, words as in the scan."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def length(text: str) -> int:
    """The words of a template, as in the scan."""
    return len(re.sub(r"[\W_]+", " ", text.lower()).split())


def signature(text: str, threshold: float = THRESHOLD) -> list[str]:
    """Bigrams of a template of which every match has one at least.

    Dice at least t asks for t / (2 - t) of the template's bigrams, so of one more than may be
    missing, one is there. The longest are taken, as the rarest in other texts.
    """
    own = sorted(bigrams(text), key=lambda b: (-len(b), b))
    least = max(1, math.ceil(threshold / (2 - threshold) * len(own) - 1e-9))
    return own[: max(0, len(own) - least + 1)]


def _any_of(pairs: list[str]) -> str:
    """A pattern that finds any of the bigrams in a lower-case text with other characters than
    letters and digits around it. Common beginnings are compared once."""

    def branch(words: set[str]) -> str:
        if len(words) == 1:
            return next(iter(words))
        tails = {c: {w[1:] for w in words if w[0] == c} for c in sorted({w[0] for w in words if w})}
        each = "|".join(c + branch(rest) for c, rest in tails.items())
        return f"(?:{each})" + ("?" if "" in words else "")

    return r"[^\p{L}\p{N}]" + branch({b + " " for b in pairs}).replace(" ", r"[^\p{L}\p{N}]+") if pairs else "(?!)"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_matches, license, dice, matches.

    A document's units are its lines and, if it has several, its whole text (the last unit).
    A unit is lower-cased, all but letters and digits is a space, and its distinct word
    bigrams are compared with each template whose size allows the threshold: Dice at least t
    asks for sizes within a factor t / (2 - t). n_matches counts the pairs of unit and
    template at or above the threshold; license and dice are of the best pair (ties: first
    template by name) and null without one; matches lists unit:template, comma-joined, in
    order.

    All of it is one pass of row expressions: nothing is shuffled, so no key can be hot. Texts
    and lines without a bigram of any template's ``signature`` cannot match, and their bigrams
    aren't built. A very long text is one row, whose bigrams are held at a time.
    Null and empty texts have no units that match. Repeated rows and null doc_ids come out as
    they come in; other columns are ignored; an empty table gives an empty result.
    """
    named = sorted((templates or TEMPLATES).items())
    text = F.coalesce(F.col(text_col), F.lit(""))
    telling = _any_of(sorted({b for _, notice in named for b in signature(notice, threshold)}))
    none = F.array().cast("array<string>")
    blank = F.lit(" ")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.concat(blank, text, blank)).alias("t"))
    rows = rows.select("doc_id", F.when(F.col("t").rlike(telling), F.regexp_replace("t", r"[^\p{L}\p{N}\n]+", " ")).alias("t"))
    lines = rows.select("doc_id", "t", F.when(F.col("t").isNull(), none).otherwise(F.split("t", "\n")).alias("lines"))
    whole = F.when(F.size("lines") > 1, F.array(F.regexp_replace("t", "[ \n]+", " "))).otherwise(none)
    units = lines.select("doc_id", F.transform(F.concat("lines", whole), lambda u: F.concat(blank, u, blank)).alias("units"))
    split = lambda u: F.split(F.trim(u), " ")
    sets = units.select(
        "doc_id",
        F.transform("units", split).alias("words"),
        F.transform("units", lambda u: F.when(u.rlike(telling), _bigrams(split(u))).otherwise(none)).alias("sets"),
    )
    notices = _notices(named, threshold)

    def against(found: Column, unit: Column) -> Column:
        n = F.size(found)

        def compared(x: Column) -> Column:
            common = F.size(F.array_intersect(found, x["own"]))
            dice = F.when((n >= x["low"]) & (n <= x["high"]), F.lit(2.0) * common / (n + x["n"]))
            return F.struct(dice.alias("dice"), x["k"].alias("k"), unit.alias("unit"), x["name"].alias("name"))

        return F.filter(F.transform(notices, compared), lambda x: x["dice"] >= threshold)

    every = _pairs({b for _, notice in named for b in bigrams(notice)})
    related = F.array_intersect(F.get("sets", F.size("sets") - 1), every)
    near = F.filter(F.transform("sets", lambda found, unit: F.struct(found.alias("found"), unit.alias("unit"))), lambda x: F.size(x["found"]) > 0)
    hits = sets.select("doc_id", "words", F.flatten(F.transform(near, lambda x: against(x["found"], x["unit"]))).alias("hits"), related.alias("related"))
    windows = F.flatten(F.transform(notices, lambda x: _windows(x, threshold)))
    # a shorter list has no template's share of bigrams
    fewest = threshold / (2 - threshold) * min(len(bigrams(notice)) for _, notice in named)
    hits = hits.withColumn("windows", F.when(F.size("related") >= fewest, windows).otherwise(F.array().cast(_WINDOWS)))
    hits = hits.withColumn("windows", F.when(F.size("windows") > 0, _apart(F.col("windows"), F.col("hits"), F.col("words"))).otherwise(F.col("windows")))
    key = lambda x: F.struct(x["dice"].alias("dice"), x["k"].alias("k"), x["name"].alias("name"))
    hits = hits.withColumn("best", F.array_max(F.concat(F.transform("hits", key), F.transform("windows", key))))
    units = F.transform("hits", lambda x: F.concat_ws(":", x["unit"].cast("string"), x["name"]))
    inside = F.transform(F.array_sort("windows"), lambda x: F.concat(F.lit("w"), x["start"].cast("string"), F.lit(":"), x["name"]))
    return hits.select(
        "doc_id",
        (F.size("hits") + F.size("windows")).cast("long").alias("n_matches"),
        F.col("best.name").alias("license"),
        F.round("best.dice", 6).alias("dice"),
        F.concat_ws(",", F.concat(units, inside)).alias("matches"),
    )


_WINDOWS = "array<struct<start:int,end:int,dice:double,k:int,name:string>>"


def _pairs(pairs: set[str]) -> Column:
    return F.split(F.lit(",".join(sorted(pairs))), ",")


def _notices(named: list[tuple[str, str]], threshold: float) -> Column:
    """The templates, an array that the optimiser makes a constant."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows = []
    for k, (name, notice) in enumerate(named):
        own = bigrams(notice)
        values = {"k": -k, "name": name, "n": len(own), "low": low * len(own), "high": high * len(own), "size": length(notice)}
        rows.append(F.struct(*(F.lit(v).alias(c) for c, v in values.items()), _pairs(set(own)).alias("own")))
    return F.array(*rows)


def _windows(x: Column, threshold: float) -> Column:
    """The windows of the whole text that match template x, from columns words and related."""
    text = F.element_at("words", -1)
    starts = F.filter(F.sequence(F.lit(0), F.size(text) - 2), lambda i: F.array_contains(x["own"], F.concat_ws(" ", F.get(text, i), F.get(text, i + 1))))

    def window(i: Column) -> Column:
        found = _bigrams(F.slice(text, i + 1, x["size"]))
        # one value of the set for both of its uses
        dice = F.transform(F.array(found), lambda y: F.when(F.size(y).between(x["low"], x["high"]), F.lit(2.0) * F.size(F.array_intersect(y, x["own"])) / (F.size(y) + x["n"])))
        return F.struct(i.alias("start"), F.least(i + x["size"], F.size(text)).alias("end"), F.get(dice, F.lit(0)).alias("dice"), x["k"].alias("k"), x["name"].alias("name"))

    matching = F.filter(F.transform(starts, window), lambda y: y["dice"] >= threshold)
    # Dice at least t asks for that share of the template's bigrams
    return F.when(F.size(F.array_intersect("related", x["own"])) >= x["low"], matching.cast(_WINDOWS)).otherwise(F.array().cast(_WINDOWS))


def _apart(windows: Column, hits: Column, words: Column) -> Column:
    """The best of overlapping windows of a template, outside of what has matched as a unit."""
    counts = F.transform(words, lambda x: F.size(F.filter(x, lambda w: w != "")))
    before = lambda u: F.aggregate(F.slice(counts, F.lit(1), u), F.lit(0), lambda a, b: a + b)
    whole = lambda u: (u > 0) & (u == F.size(words) - 1)
    ranges = F.transform(hits, lambda x: F.struct(F.when(whole(x["unit"]), 0).otherwise(before(x["unit"])).alias("start"), F.get(counts, x["unit"]).alias("n"), x["name"].alias("name")))
    within = lambda x, start, end: (x["start"] >= start) & (x["end"] <= end)
    meets = lambda x, start, end: (x["start"] < end) & (x["end"] > start)
    better = lambda y, x: (y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["start"] < x["start"]))
    taken = lambda x: F.exists(ranges, lambda r: within(x, r["start"], r["start"] + r["n"]) | ((x["name"] == r["name"]) & meets(x, r["start"], r["start"] + r["n"])))
    best = F.filter(windows, lambda x: ~F.exists(windows, lambda y: (x["name"] == y["name"]) & meets(x, y["start"], y["end"]) & better(y, x)))
    longer = lambda y, x: (y["end"] - y["start"] > x["end"] - x["start"]) & within(x, y["start"], y["end"])
    return F.filter(best, lambda x: ~taken(x) & ~F.exists(best, lambda y: longer(y, x)))


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the scan of ``documents``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(name)}, [{', '.join(map(quoted, bigrams(notice)))}])" for k, (name, notice) in enumerate(sorted((templates or TEMPLATES).items())))
    return rf"""
WITH templates(k, name, own) AS (VALUES {values}),
norm AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents),
lined AS (SELECT doc_id, t, string_split(t, chr(10)) AS lines FROM norm),
units AS (SELECT doc_id, CASE WHEN len(lines) > 1 THEN list_append(lines, regexp_replace(t, '[ \n]+', ' ', 'g')) ELSE lines END AS us FROM lined),
unit AS (SELECT doc_id, generate_subscripts(us, 1) - 1 AS unit, string_split(trim(unnest(us)), ' ') AS w FROM units),
sets AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM unit WHERE len(w) > 1),
dice AS (SELECT doc_id, unit, k, name, 2.0 * len(list_intersect(s, own))::DOUBLE / (len(s) + len(own)) AS dice
         FROM sets JOIN templates ON len(s) >= {threshold / (2 - threshold)!r} * len(own) AND len(s) <= {(2 - threshold) / threshold!r} * len(own)),
hits AS (SELECT doc_id, count(*) AS n, arg_max(name, struct_pack(d := dice, k := -k)) AS license, max(dice) AS dice,
                string_agg(unit || ':' || name, ',' ORDER BY unit, k) AS matches FROM dice WHERE dice >= {threshold!r} GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_matches, license, round(dice, 6) AS dice, coalesce(matches, '') AS matches
FROM documents d LEFT JOIN hits USING (doc_id)
"""
