"""Licence scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment decides.

A template of n tokens is looked for in windows of n + stride - 1 tokens that start every ``stride`` tokens, so any
occurrence lies whole in one window and the two shingle sets differ by the stride at most. With ``BANDS`` bands of
one row each, a window of Jaccard similarity s is retrieved with probability 1 - (1 - s)^BANDS: a window that
verifies has s of at least 0.57 for the strides used, which leaves less than 2e-6 to chance. Shingles have five words,
or the whole of a notice that is shorter.

Windows that cannot verify are not made: every window that verifies holds a word of the hitting set, which meets more
than a fifth of each template's shingles, and a window that verifies shares at least four fifths of them. The SQL of
this query knows neither windows of such words nor MinHash: it counts shared shingles. Templates are a constant list.

Defined results: null and empty texts match nothing; repeated rows are counted together under their id; the same
licence in several places is one row with the number of windows that verify; of equal places the first token is given;
very long texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.sources.tables import table

SHINGLE, BANDS, CONTAINMENT = 5, 16, 0.8
#: Words that are no sign of a licence by themselves.
COMMON = frozenset("a all an and any are at by copy extent file following for form free hereby in is law may no of on option or part person possible public rights source subject terms that the this to under use version with without work you".split())
_TOKEN = r"[\p{L}\p{N}]+"
#: Wording of common licence notices and bodies, as their owners publish them.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "either version 3 of the License, or (at your option) any later version"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "either version 2 of the License, or (at your option) any later version"),
    "GPL": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",),
    "LGPL-3.0": ("licensed under the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("licensed under the GNU Affero General Public License, version 3",),
    "BSD-2-Clause": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Proprietary": ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form"),
}
#: Licences that are also named by an identifier line.
TAGGED = ("MIT", "ISC", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "CC-BY-4.0", "CC0-1.0", "Unlicense")


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def width(n: int) -> int:
    """Words of a shingle of a notice of n tokens."""
    return min(SHINGLE, n)


def _shingles(tokens: list[str]) -> list[str]:
    k = width(len(tokens))
    return list(dict.fromkeys(" ".join(tokens[i : i + k]) for i in range(len(tokens) - k + 1)))


def notices() -> list[tuple[str, int, int, list[str]]]:
    """(licence, number, tokens, shingles) of every template."""
    worded = {name: [*ts, *[f"SPDX-License-Identifier: {name}"] * (name in TAGGED)] for name, ts in TEMPLATES.items()}
    return [(name, k, len(_tokens(t)), _shingles(_tokens(t))) for name, ts in worded.items() for k, t in enumerate(ts)]


def stride(n: int) -> int:
    return max(1, n // 8)


def needed(shingles: list[str]) -> int:
    """How many of a template's shingles must be met so that every window that verifies shares a met one."""
    return len(shingles) - math.ceil(CONTAINMENT * len(shingles)) + 1


def hitting_words() -> list[str]:
    """Uncommon words that meet enough shingles of every template, greedily."""
    todo = [(set(ss), needed(ss)) for _, _, _, ss in notices()]
    words: list[str] = []
    met = lambda ss: sum(any(w in s.split() for w in words) for s in ss)
    while lacking := [ss for ss, n in todo if met(ss) < n]:
        counts: dict[str, int] = {}
        for ss in lacking:
            for s in ss:
                if not any(w in s.split() for w in words):
                    for w in set(s.split()) - COMMON:
                        counts[w] = counts.get(w, 0) + 1
        words.append(max(counts, key=lambda w: (counts[w], len(w), w)))
    return sorted(words)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _shingle_hashes(w: Column, k: int) -> Column:
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _seeded(hashes: Column) -> Column:
    """``BANDS`` rows of hashes, one per seed."""
    of = lambda j: lambda x: F.xxhash64(x, F.lit(j))
    return F.array(*[F.transform(hashes, of(j)) for j in range(BANDS)])


def template_table(spark: SparkSession) -> DataFrame:
    """(license, notice, tokens, shingles, band, value): constant and small."""
    base = spark.createDataFrame(notices(), "license string, notice int, tokens int, shingles array<string>")
    parted = F.transform("shingles", lambda x: F.split(x, " "))
    of = lambda k: F.transform(parted, lambda p: F.xxhash64(*[F.get(p, F.lit(j)) for j in range(k)]))
    hashes = of(SHINGLE)
    for k in range(1, SHINGLE):
        hashes = F.when(F.col("tokens") == k, of(k)).otherwise(hashes)
    mins = _let(hashes, lambda h: F.transform(_seeded(h), F.array_min))
    return base.select("*", F.posexplode(mins).alias("band", "value"))


def _windows(w: Column, classes: list[int]) -> Column:
    """Windows of every class that hold a word of the hitting set: array of (tokens, at, x, mins).

    Hashes and their seeded forms are made once per place; a window only takes minima of slices.
    """
    marks = F.array(*[F.lit(x) for x in hitting_words()])
    hits = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(marks, x), i)), lambda i: i.isNotNull())

    def starts(h: Column, n: int) -> Column:
        s, size = stride(n), n + stride(n) - 1
        last = F.floor((F.size(w) - width(n)) / F.lit(s)).cast("int")

        def around(p: Column) -> Column:
            low = F.greatest(F.lit(0), F.ceil((p - (size - 1)) / F.lit(s)).cast("int"))
            high = F.least(last, F.floor(p / F.lit(s)).cast("int"))
            return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * s)).otherwise(F.array().cast("array<int>"))

        return F.array_distinct(F.flatten(F.transform(h, around)))

    def one(m: Column, n: int):
        size = n + stride(n) - 1
        return lambda i: F.struct(F.lit(n).alias("tokens"), i.alias("at"), F.slice(w, i + 1, size).alias("x"), F.transform(m, lambda r: F.array_min(F.slice(r, i + 1, size - width(n) + 1))).alias("mins"))

    def of_width(h: Column, k: int) -> Column:
        mine = [n for n in classes if width(n) == k]
        return _let(_shingle_hashes(w, k), lambda g: _let(_seeded(g), lambda m: F.concat(*[F.transform(starts(h, n), one(m, n)) for n in mine])))

    return _let(hits, lambda h: F.concat(*[of_width(h, k) for k in sorted({width(n) for n in classes})]))


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, first_token, n_windows, containment): the first token of the first window that verifies, how many do, and the best share."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    some = docs.where(low.rlike(r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(hitting_words()) + r")(?:$|[^\p{L}\p{N}])"))
    classes = sorted({n for _, _, n, _ in notices()})
    cut = _let(F.regexp_extract_all(low, F.lit(_TOKEN), 0), lambda w: _windows(w, classes))
    rows = some.select(F.col(key).alias("key"), F.explode(cut).alias("s")).select("key", "s.*")
    banded = rows.select("key", "tokens", "at", "x", F.posexplode("mins").alias("band", "value"))
    found = banded.join(F.broadcast(template_table(docs.sparkSession)), ["tokens", "band", "value"])
    k = F.least(F.lit(SHINGLE), F.col("tokens"))
    own = F.transform(F.sequence(F.lit(1), F.size("x") - k + 1), lambda i: F.array_join(F.slice("x", i, k), " "))
    share = F.size(F.array_intersect(own, F.col("shingles"))) / F.size("shingles")
    right = found.withColumn("share", share).where(F.col("share") >= CONTAINMENT)
    return right.groupBy("key", "license").agg(F.min("at").alias("first_token"), F.countDistinct("notice", "at").alias("n_windows"), F.floor(F.max("share") * 10000 + 0.5).alias("containment")).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    rows = ",\n".join(f"('{name}', {k}, {n}, {width(n)}, {stride(n)}, [{', '.join(repr(x) for x in ss)}])" for name, k, n, ss in notices())
    return rf"""
WITH t(license, notice, n, k, stride, shingles) AS (VALUES {rows}),
ts AS (SELECT license, notice, n, k, stride, len(shingles) AS size, unnest(shingles) AS shingle FROM t),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}') AS w FROM documents),
s AS (SELECT doc_id, k, pos, array_to_string(w[pos + 1:pos + k], ' ') AS shingle FROM (SELECT doc_id, k, w, unnest(range(0, len(w) - k + 1)) AS pos FROM d CROSS JOIN (SELECT DISTINCT k FROM t))),
h AS (SELECT doc_id, license, notice, n, stride, size, shingle, pos, greatest(0, CAST(ceil((pos - (n + stride - 1 - k)) / stride::DOUBLE) AS BIGINT)) AS low, pos // stride AS high FROM s JOIN ts USING (k, shingle)),
x AS (SELECT doc_id, license, notice, size, shingle, unnest(range(low, high + 1)) * stride AS spot FROM h),
r AS (SELECT doc_id, license, notice, spot, CAST(count(DISTINCT shingle) AS DOUBLE) / any_value(size) AS share FROM x GROUP BY 1, 2, 3, 4)
SELECT doc_id, license, CAST(min(spot) AS INTEGER) AS first_token, count(DISTINCT (notice, spot)) AS n_windows, CAST(floor(max(share) * 10000 + 0.5) AS BIGINT) AS containment FROM r WHERE share >= {CONTAINMENT} GROUP BY 1, 2
"""


ORACLE_SQL = _oracle()
