"""Licence scan in Spark SQL alone: Dice coefficient of word bigrams against licence templates.

Texts and templates are normalised to lower-case words. A passage (one or more consecutive
sentences of a line or of a block, a line, a block between blank lines, the text) matches a template if the Dice
coefficient of their sets of word bigrams reaches ``threshold``. Sentences of a block run over its
line breaks and the marks at line starts; lines without a letter or digit are blank. Two bounds prune without loss:

* Size. dice(A, B) >= t needs t/(2-t) |B| <= |A| <= (2-t)/t |B|; passages of other sizes meet no template.
* Shared words. Such a passage holds over t/(2-t) of a template's bigrams. Anchors are words of a
  template that touch more than the rest of them, so every matching passage has an anchor.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Notices and opening terms of common licences, by SPDX name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "GPL-3.0": [
        "This file is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "No part of this publication may be reproduced without permission."],
}
THRESHOLD = 0.8
SENTENCE = r"(?<=[.!?:])[ \t]+"
#: Marks of comments and quotations, and blanks, at the start of a line; all of a line without a letter or digit.
MARGIN = r"(?md)^[^\p{L}\p{N}\n]+"


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> set[str]:
    w = words(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def anchors(grams: set[str], threshold: float) -> set[str]:
    """Words touching more bigrams than a matching passage can lack; long words first."""
    most = len(grams) * (1 - threshold / (2 - threshold))
    left, out = set(grams), set()
    while left and len(grams) - len(left) <= most:
        count = Counter(w for g in left for w in set(g.split()))
        word = max(count, key=lambda w: (min(len(w), 7), count[w], w))
        out.add(word)
        left = {g for g in left if word not in g.split()}
    return out


def template_rows(threshold: float) -> list[tuple[int, str, int, list[str]]]:
    return [(i, name, len(bigrams(t)), sorted(bigrams(t))) for i, (name, t) in enumerate((n, t) for n, ts in TEMPLATES.items() for t in ts)]


def anchor_words(threshold: float) -> list[str]:
    return sorted(set().union(*(anchors(set(g), threshold) for *_, g in template_rows(threshold))))


def longest() -> int:
    """Sentences of the longest template."""
    return max(len(re.split(SENTENCE, t)) for ts in TEMPLATES.values() for t in ts)


def normalised(text: Column) -> Column:
    """Array of lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def bigrams_of(text: Column, low: int, high: int) -> Column:
    """Distinct word bigrams; null if their number is outside low to high."""
    pairs = lambda w: F.array_distinct(F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.element_at(w, i + 2))))
    return let(normalised(text), lambda w: F.when(F.size(w) >= 2, let(pairs(w), lambda g: F.when(F.size(g).between(low, high), g))))


def scan(docs: DataFrame, threshold: float = THRESHOLD, by: str = "doc_id") -> DataFrame:
    """(``by``, license, template, dice, passages, matched) for each row and licence found.

    ``dice`` is the best over the passages, ``passages`` how many match, ``matched`` the first of the best
    in code-point order. Rows without text or licence give none. Rows that share a value of ``by`` are taken together.
    """
    spark = docs.sparkSession
    rows = template_rows(threshold)
    sizes = [n for *_, n, _ in rows]
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    low, high = int(min(sizes) * least), int(max(sizes) * most) + 1
    anchor = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(anchor_words(threshold))})(?![\p{{L}}\p{{N}}])"
    text = F.col("text").cast("string")
    some = lambda array: F.filter(array, lambda x: x.rlike(anchor))
    runs = lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size(s), F.lit(longest()))), lambda w: F.transform(F.sequence(F.lit(1), F.size(s) - w + 1), lambda at: F.array_join(F.slice(s, at, w), " "))))
    windows = lambda lines: F.flatten(F.transform(lines, lambda x: let(F.split(x, SENTENCE), runs)))
    wrapped = F.filter(F.split(F.regexp_replace(text, MARGIN, ""), r"\n{2,}"), lambda x: x.contains("\n") & x.rlike(anchor))
    blocks = F.transform(wrapped, lambda x: F.regexp_replace(x, r"[ \t\r]*\n", " "))
    parts = let(some(F.split(text, r"\n")), lambda lines: F.concat(F.array(text), F.split(text, r"\n\s*\n"), lines, some(windows(lines)), blocks, some(windows(blocks))))
    passages = docs.where(text.rlike(anchor)).select(by, F.explode(F.array_distinct(some(parts))).alias("passage"))
    grams = passages.select(by, "passage", bigrams_of(F.col("passage"), low, high).alias("grams")).where("grams is not null")
    each = grams.select(by, "passage", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    templates = spark.createDataFrame([(i, name, n, g) for i, name, n, gs in rows for g in gs], "template int, license string, size int, gram string")
    # The templates are a fixed list: broadcasting it is bounded.
    near = each.join(F.broadcast(templates), "gram").where(F.col("n").between(F.col("size") * least - 1e-9, F.col("size") * most + 1e-9))
    shared = near.groupBy(by, "license", "template", "size", "passage", "n").agg(F.count_distinct("gram").alias("both"))
    hits = shared.select(by, "license", "template", "passage", (2.0 * F.col("both") / (F.col("n") + F.col("size"))).alias("dice")).where(F.col("dice") >= threshold)
    best = hits.groupBy(by, "license").agg(F.min(F.struct(-F.col("dice"), "template", "passage")).alias("b"), F.count_distinct("passage").alias("passages"))
    return best.select(by, "license", F.col("b.template").alias("template"), (-F.col("b.col1")).alias("dice"), "passages", F.col("b.passage").alias("matched"))


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_licenses, license, dice, licenses) of every row: the best licence (null if none), its Dice, all names by code point."""
    # Rows find their hits by id and text, so rows without an id, or that share one, have their own.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row_key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    found = scan(rows, threshold, "row_key").groupBy(F.col("row_key").alias("found_key")).agg(
        F.count("*").alias("n"), F.min(F.struct(-F.col("dice"), "license")).alias("b"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("all")
    )
    out = rows.select("doc_id", "row_key").join(found, F.col("row_key") == F.col("found_key"), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_licenses"), F.col("b.license").alias("license"), F.round(-F.col("b.col1"), 6).alias("dice"), F.coalesce("all", F.lit("")).alias("licenses"))
