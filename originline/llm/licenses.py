"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

A template of w words is looked for in windows of about 1.25 w words that start
every w / 4 words, so that each occurrence lies whole in some window. A window and
a template are compared by bands of MinHash values of their shingles; a window
that shares a band with a template retrieves it, and the exact containment of the
template's shingles in the window decides.

Bands: 16 of 2 values. A window that holds the template whole has a Jaccard
similarity of about 0.8 and shares a band with a chance of 1 - (1 - 0.64)^16, more
than 0.9999999; one that holds four fifths of its shingles (0.58), 0.998; and an
occurrence lies in more than one window near its edges.

A few rare words, the anchors, are chosen so that a window without one lacks more
of any template than a match may; only windows around an anchor are hashed, and
only texts with one are split at all.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from originline.llm.common import prepare

WIDTH = 5
BANDS, VALUES = 16, 2
WORDS = "[^\\p{L}\\p{N}]+"

# Public license notices, as their licenses word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License "
                   "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    # Further wordings of short notices.
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    # Standard headers.
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    # Full texts of the short licenses.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
                     "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
                     "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                     "other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
                     "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
                     "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
                     "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                     "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
                     "its contributors may be used to endorse or promote products derived from this software without specific prior "
                     "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
                     "EXPRESS OR IMPLIED WARRANTIES"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
                  "for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
             "for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
                "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
                "execute, and transmit the Software, and to prepare derivative works of the Software"),
)
# Words too common to anchor a search.
COMMON = frozenset(
    "a an and any are as at by for from in is it of on or that the this to under use with without you work person".split())


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def shingles_of(words: list[str]) -> list[str]:
    v = min(WIDTH, len(words))
    return sorted({" ".join(words[i : i + v]) for i in range(len(words) - v + 1)})


def anchors_of(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> list[str]:
    """A small set of words without which no window reaches ``least`` of a template.

    Of each template more shingles hold an anchor than a match may lack.
    """
    sets = [set(shingles_of(w)) for _, t in templates if (w := words_of(t))]
    lack = [len(s) - math.ceil(least * len(s) - 1e-9) for s in sets]
    found: set[str] = set()

    def short(s: set[str], may: int, anchors: set[str]) -> int:
        return max(0, may + 1 - sum(1 for x in s if anchors & set(x.split())))

    while missing := sum(short(s, may, found) for s, may in zip(sets, lack, strict=True)):
        words = {w for s, may in zip(sets, lack, strict=True) if short(s, may, found) for x in s for w in x.split()} - found
        rare = {w for w in words if w not in COMMON and len(w) > 3} or words
        gain = {w: missing - sum(short(s, may, found | {w}) for s, may in zip(sets, lack, strict=True)) for w in rare}
        found.add(min(gain, key=lambda w: (-gain[w], -len(w), w)))
    return sorted(found)


def _hash(shingle: Column) -> Column:
    return F.xxhash64(shingle)


def _shingles(words: Column, n: Column, v: int) -> Column:
    """Hashes of all runs of ``v`` words; none if there are fewer."""
    return F.when(
        n >= v,
        F.transform(F.sequence(F.lit(1), n - v + 1), lambda i: _hash(F.array_join(F.slice(words, i, v), " "))),
    ).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column) -> Column:
    """Keys of all bands of a set of shingle hashes."""


    def smallest(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(k))))

    least = [smallest(k) for k in range(BANDS * VALUES)]
    return F.array(*[F.xxhash64(F.lit(b), *least[b * VALUES : (b + 1) * VALUES]) for b in range(BANDS)])


def _windows(w: int) -> Column:
    """The windows for templates of ``w`` words that hold an anchor, from ``at`` and the shingle columns."""
    step, v = max(1, w // 4), min(WIDTH, w)
    length = w + step - 1

    def around(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.ceil((i - length + 1) / step).cast("int"))
        return F.sequence(low, F.floor(i / step).cast("int"))

    def window(g: Column) -> Column:
        shingles = F.slice(F.col(f"s{v}"), g * step + 1, F.lit(length - v + 1))
        return F.struct(F.lit(w).alias("n_words"), (g * step).alias("start"), shingles.alias("shingles"))

    return F.transform(F.array_distinct(F.flatten(F.transform("at", around))), window)


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """A row per template: number, license, words, shingle width, shingle hashes, band keys."""
    rows = [(k, name, w) for k, (name, text) in enumerate(templates) if (w := words_of(text))]
    if not rows:
        return spark.range(0).selectExpr(
            "0 AS template", "'' AS license", "0 AS n_words", "0 AS width", "array(0L) AS wanted", "array(0L) AS bands")
    cells = [
        F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(len(w)).alias("n_words"),
                 F.lit(min(WIDTH, len(w))).alias("width"), F.array(*map(F.lit, shingles_of(w))).alias("parts"))
        for k, name, w in rows
    ]
    base = spark.range(1).select(F.inline(F.array(*cells)))
    hashed = base.withColumn("wanted", F.transform("parts", _hash)).drop("parts")
    return hashed.withColumn("bands", _bands(F.col("wanted")))


def confusable(templates: tuple[tuple[str, str], ...] = TEMPLATES, share: float = 0.4) -> list[tuple[str, str]]:
    """Pairs of licenses of which a template of one holds ``share`` of the shingles of one of the other."""
    sets = [(name, set(shingles_of(w))) for name, text in templates if (w := words_of(text))]
    return sorted({(a, b) for a, x in sets for b, y in sets if a != b and len(x & y) >= share * min(len(x), len(y))})


def _best_of_alike(found: DataFrame, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """The hits less those that a better hit of a confusable license explains.

    A document has one row per license at most, so they are compared in one array of it.
    Of two confusable licenses in the same words the one with the larger containment
    stays; of equal ones the one that matched more shingles.
    """
    pairs = confusable(templates)
    if not pairs:
        return found
    alike = F.array(*[F.lit(f"{a}|{b}") for a, b in pairs])
    cells = ["license", "containment", "start_word", "n_windows", "matched", "until"]
    lists = found.groupBy("doc_id").agg(F.collect_list(F.struct(*cells)).alias("_hits"))

    def beaten(x: Column) -> Column:
        def beats(y: Column) -> Column:
            near = (y["start_word"] < x["until"]) & (x["start_word"] < y["until"])
            better = (y["containment"] > x["containment"]) | ((y["containment"] == x["containment"]) & (y["matched"] > x["matched"]))
            return F.array_contains(alike, F.concat_ws("|", x["license"], y["license"])) & near & better

        return F.exists("_hits", beats)

    return lists.select("doc_id", F.inline(F.filter("_hits", lambda x: ~beaten(x))))


def _once(df: DataFrame, keep: list[str], *values: Column) -> DataFrame:
    """``keep`` and ``values``, computed once a row.

    Inside an array function a column of the same stage would be computed again for
    each element; a generator in between holds its value.
    """
    return df.select(*keep, F.explode(F.array(F.struct(*values))).alias("_held")).select(*keep, "_held.*")


def scan(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8,
) -> DataFrame:
    """A row per (doc_id, license) whose text contains ``least`` of a template's shingles in one window.

    Columns: ``doc_id``, ``license``, ``containment`` (best), ``start_word`` (of the
    best window, counted in runs of letters and digits), ``n_windows`` that match.
    Licenses whose templates are alike (BSD-2 and BSD-3, the GNU headers) are told
    apart by the better match; an opening that several share is named by their family.
    Shingles have five words; a shorter template is one shingle. Case and
    punctuation do not count. A null or empty text matches nothing; rows that share
    a doc_id are one document; an empty table gives an empty result; other columns
    are ignored; texts are read whole.
    """
    spark = prepare(docs.sparkSession)
    anchors = anchors_of(templates, least)
    lower = F.lower(F.col("text").cast("string"))
    maybe = F.lit(False)
    for word in anchors:
        if not any(other in word for other in anchors if other != word):
            maybe = maybe | lower.contains(word)
    classes = sorted({len(w) for _, t in templates if (w := words_of(t))})
    widths = sorted({min(WIDTH, w) for w in classes})
    known = F.array(*[F.lit(a) for a in anchors])
    words, n = F.col("words"), F.size("words")
    split = _once(docs.where(maybe), ["doc_id"], F.filter(F.split(lower, WORDS), lambda w: w != "").alias("words"))
    split = _once(split.where(n > 0), ["doc_id"], words, F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(known, F.element_at(words, i + 1))).alias("at"))
    split = _once(split.where(F.size("at") > 0), ["doc_id"], F.col("at"), *[_shingles(words, n, v).alias(f"s{v}") for v in widths])
    cut = split.select("doc_id", F.explode(F.concat(*[_windows(w) for w in classes])).alias("window")).select("doc_id", "window.*")
    cut = cut.where(F.size("shingles") > 0)
    keyed = cut.select("doc_id", "n_words", "start", "shingles", F.explode(_bands(F.col("shingles"))).alias("band"))
    # The templates are a fixed list in this module or an argument: a few rows.
    table = template_table(spark, templates)
    side = table.select("template", "license", "n_words", "wanted", F.explode("bands").alias("band"))
    met = keyed.join(F.broadcast(side), ["n_words", "band"])
    share = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    hits = met.select(
        "doc_id", "license", "template", "start", "n_words", share.alias("containment"),
        F.size(F.array_intersect("shingles", "wanted")).alias("matched")).where(F.col("containment") >= least)
    once = hits.groupBy("doc_id", "license", "template", "start", "n_words").agg(
        F.max("containment").alias("containment"), F.max("matched").alias("matched"))
    best = F.max(F.struct("containment", "matched", (-F.col("start")).alias("back"), "n_words"))
    found = once.groupBy("doc_id", "license").agg(best.alias("best"), F.count("*").alias("n_windows")).select(
        "doc_id", "license", F.col("best.containment").alias("containment"),
        (-F.col("best.back")).cast("long").alias("start_word"), "n_windows", F.col("best.matched").alias("matched"),
        (-F.col("best.back") + F.col("best.n_words") * 1.25).cast("long").alias("until"))
    return _best_of_alike(found, templates).select("doc_id", "license", "containment", "start_word", "n_windows")
