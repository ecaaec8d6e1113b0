"""Licence scans: normalised text compared with licence templates by the Dice coefficient over word bigrams.

Each document's lines, paragraphs and the text as a whole are candidates. A candidate is compared
with a template only if the sizes of the two bigram sets allow the similarity: at t, the larger set
has at most (2 - t) / t times the smaller one's bigrams. Before that, a document must hold one of the
template's rarest bigrams: at t a match has more than t / (2 - t) of the template's bigrams, so it has
one of any larger remainder. Both bounds are exact. All in one projection, without a shuffle or Python.

What no matching line, paragraph or whole text covers is then searched for notices among other words: every
window of words that begins and ends with a bigram of the template (others only lower the score) and has no more
bigrams than the similarity allows. The best window counts once for each template.

Defined cases: a null or empty text has no licence; among equal scores the first template by name wins;
a repeated row gets the same answer twice; an empty table gives an empty table; columns other than
doc_id and text are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import common

#: Notices as their licences word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: The least Dice coefficient of a match, as a fraction so that the bounds are exact.
LEAST = Fraction(4, 5)


def plain(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors_of(templates: dict[str, str], least: Fraction) -> dict[str, list[str]]:
    """For each template its rarest bigrams, so many that every match holds one of them."""
    sets = {k: bigrams(plain(v)) for k, v in templates.items()}
    out = {}
    for name, own in sets.items():
        needed = least / (2 - least) * len(own)
        spare = len(own) - (-(-needed.numerator // needed.denominator)) + 1
        out[name] = sorted(own, key=lambda g: (sum(g in s for s in sets.values()), -len(g), g))[:spare]
    return out


def anchors(templates: dict[str, str], least: Fraction) -> list[str]:
    return sorted({g for own in anchors_of(templates, least).values() for g in own})


def normalised(text: str) -> Column:
    """Lower case, everything but a-z and 0-9 as one space, line feeds kept as ' \\n '."""
    ascii_low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(ascii_low, r"[^a-z0-9\n]+", " "), r"\n", " \n "), F.lit(" "))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: Fraction = LEAST) -> DataFrame:
    """doc_id, license (null if none), dice and n_matches (candidates that match) for every row of docs."""
    sets = {k: bigrams(plain(v)) for k, v in sorted(templates.items())}
    ratio = (2 - least) / least
    largest = int(ratio * max(map(len, sets.values())))
    num, den = least.numerator, least.denominator
    rows = common.text_rows(docs).select("doc_id", normalised("text").alias("norm"))
    flat = F.regexp_replace("norm", r"\s+", " ")
    rows = rows.withColumn("flat", flat).withColumn("maybe", F.col("flat").rlike(f" (?:{'|'.join(anchors(templates, least))}) "))
    none = F.expr("cast(array() as array<struct<dice:double,name:string>>)")

    def in_order(part: Column) -> Column:
        words = F.filter(F.split(part, r"\s+"), lambda w: w != "")
        return F.transform(F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b")), lambda p: p["b"].isNotNull()), lambda p: F.concat_ws(" ", p["a"], p["b"]))

    def grams(part: Column) -> Column:
        return F.array_distinct(in_order(part))

    def compared(own: Column) -> Column:
        """Scores of one candidate's bigrams against the templates that its size allows."""
        found = []
        for name, grams_of in sets.items():
            size, n = F.size(own), len(grams_of)
            low, high = -(-n * ratio.denominator // ratio.numerator), n * ratio.numerator // ratio.denominator
            both = F.size(F.array_intersect(own, F.array(*map(F.lit, grams_of))))
            found.append(F.when(size.between(low, high), F.when(2 * den * both >= num * (size + n), F.struct((2.0 * both / (size + n)).alias("dice"), F.lit(name).alias("name")))))
        return F.array_compact(F.array(*found))

    lines = F.split("norm", "\n")
    blocks = F.split(F.regexp_replace("norm", r"\n[ \n]*\n", "\u0001"), "\u0001")
    parts = F.filter(F.array_distinct(F.transform(F.concat(lines, blocks, F.array("flat")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))), lambda x: F.size(F.split(x, " ")) > 1)
    small = F.filter(F.transform(parts, grams), lambda g: F.size(g).between(1, largest))
    hits = F.when(F.col("maybe"), F.flatten(F.transform(small, compared))).otherwise(none)
    rows = rows.select("doc_id", "maybe", "norm", "flat", hits.alias("whole"))

    def matches(part: Column) -> Column:
        own = grams(part)
        return F.size(own).between(1, largest) & (F.size(compared(own)) > 0)

    def uncovered(part: Column, inner: Column) -> Column:
        return F.when(matches(part), F.lit(" | ")).otherwise(inner)

    left = F.array_join(F.transform(blocks, lambda block: uncovered(block, F.array_join(F.transform(F.split(block, "\n"), lambda line: uncovered(line, line)), " "))), " ")
    left = F.when(F.size("whole") == 0, F.col("flat")).when(matches(F.col("flat")), F.lit(" ")).otherwise(F.regexp_replace(left, r"\s+", " "))
    rows = rows.select("doc_id", "maybe", "whole", F.when(F.col("maybe"), left).otherwise(" ").alias("left"))
    rows = rows.select("*", F.when(F.col("left").rlike(f" (?:{'|'.join(anchors(templates, least))}) "), in_order(F.col("left"))).alias("grams"))

    def among(some: list[str]):
        return lambda g: F.array_contains(F.array(*map(F.lit, some)), g)

    # For each bigram the place of its last occurrence before, by sorting occurrences: a bigram is new in a window if that lies before the window.
    rows = rows.withColumn("sorted", F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    before = lambda k: F.get(F.col("sorted"), k - 1)
    rows = rows.withColumn("last", F.sort_array(F.transform("sorted", lambda x, k: F.struct(x["i"].alias("i"), F.when(before(k)["g"] == x["g"], before(k)["i"]).otherwise(-1).alias("p")))))
    rows = rows.withColumn("last", F.transform("last", lambda x: x["p"])).drop("sorted")
    anchors_by = anchors_of(templates, least)
    for k, (name, grams_of) in enumerate(sets.items()):
        due = F.col("grams").isNotNull() & F.col("left").rlike(f" (?:{'|'.join(anchors_by[name])}) ")
        rows = rows.withColumn(f"hit{k}", F.when(due, F.transform("grams", among(grams_of))))
    for k in range(len(sets)):
        rows = rows.withColumn(f"at{k}", F.filter(F.transform(f"hit{k}", lambda h, i: F.when(h, i)), lambda i: i.isNotNull()))

    def window(k: int, name: str) -> Column:
        """The best window's score against one template: from each hit on, counts of new bigrams and new hits run over the bigrams that follow."""
        n, at, hit = len(sets[name]), F.col(f"at{k}"), F.col(f"hit{k}")
        needed, high = -(-n * ratio.denominator // ratio.numerator), n * ratio.numerator // ratio.denominator

        def from_start(start: Column, k: Column) -> Column:
            def step(seen: Column, i: Column) -> Column:
                new = F.get("last", i) < start
                size = seen["size"] + F.when(new, 1).otherwise(0)
                both = seen["both"] + F.when(new & F.get(hit, i), 1).otherwise(0)
                ends = F.get(hit, i) & (2 * den * both >= num * (size + n))
                return F.struct(size.alias("size"), both.alias("both"), F.when(ends, F.greatest(seen["best"], 2.0 * both / (size + n))).otherwise(seen["best"]).alias("best"))

            zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("both"), F.lit(0.0).alias("best"))
            places = F.sequence(start, F.least(start + high, F.size("grams")) - 1)
            return F.when(F.get(at, k + needed - 1) < start + high, F.aggregate(places, zero, step)["best"])

        dice = F.array_max(F.transform(at, from_start))
        found = F.transform(F.filter(F.array(dice), lambda d: d > 0), lambda d: F.struct(d.alias("dice"), F.lit(name).alias("name")))
        return F.coalesce(found, none)

    hits = F.when(F.col("grams").isNull(), F.col("whole")).otherwise(F.concat("whole", *(window(k, name) for k, name in enumerate(sets))))
    best = F.array_sort("hits", lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return (
        rows.select("doc_id", hits.alias("hits")).select("doc_id", F.size("hits").cast("long").alias("n_matches"), F.get(best, F.lit(0)).alias("best"))
        .select("doc_id", F.col("best.name").alias("license"), F.round("best.dice", 6).alias("dice"), "n_matches")
    )


def brute_force(text: str | None, templates: dict[str, str] = TEMPLATES, least: Fraction = LEAST) -> tuple[str | None, float | None, int]:
    """The same answer from all candidates against all templates; for tests."""
    text = re.sub(r"[^a-z0-9\n]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = {" ".join(p.split()) for p in [*text.split("\n"), *re.split(r"\n(?: *\n)+", text), text]}
    hits = []
    for words in map(str.split, parts):
        own = set(bigrams(words))
        for name, t in templates.items():
            other = set(bigrams(plain(t)))
            dice = Fraction(2 * len(own & other), len(own) + len(other))
            if own and dice >= least:
                hits.append((-dice, name))
    return (min(hits)[1], round(float(-min(hits)[0]), 6), len(hits)) if hits else (None, None, 0)
