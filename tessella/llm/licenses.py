"""Licence scan: lines, paragraphs and word windows against licence templates by Dice coefficient over word bigrams.

Built-in functions only. Texts are cut in lines and in paragraphs of several
lines, and those that don't match as a whole in windows of a template's size,
or a quarter more, that begin with one of its bigrams; a unit is normalised to lower-case words, and of the templates only
those whose number of bigrams can still reach the threshold (a Dice coefficient
of ``t`` bounds the ratio of the sizes by ``t / (2 - t)`` both ways) are
compared. Everything happens within a row; only found licences are shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
_NOT_WORD = r"[^\p{L}\p{N}\n]+"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
)

#: (licence, text): usual statements, notices and paragraphs of well-known licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", _WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Released under the BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Zlib", "Licensed under the zlib License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def template_bigrams(templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """Licence and sorted distinct word bigrams of each template."""
    out = []
    for name, text in templates:
        words = [w for w in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if w]
        out.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    return out


def gate_words(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which any unit that matches a template has at least one.

    A unit with coefficient ``t`` shares at least ``t / (2 - t)`` of the
    template's bigrams, so that it has one of any larger rest of them; of each
    template the rest with the longest words is taken.
    """
    gate: set[str] = set()
    for _, grams in template_bigrams(templates):
        must_share = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        longest = sorted(grams, key=lambda g: (-max(map(len, g.split(" "))), g))[: len(grams) - must_share + 1]
        gate |= {max(g.split(" "), key=lambda w: (len(w), w)) for g in longest}
    return sorted(gate)


def _in_windows(table: Column, threshold: float) -> Column:
    """Matches of windows of a unit (``pairs``, ``hits``, ``breaks``) that don't overlap; of several lines those that reach over a line feed."""

    def windows(hit: Column) -> Column:
        def of(t: Column) -> Column:
            def window(width: Column) -> Column:
                span = F.slice("pairs", hit["at"] + 1, width)
                dice = F.size(F.array_intersect(span, t["grams"])) * 2.0 / (F.size(F.array_distinct(span)) + t["n"])
                return F.struct(dice.alias("dice"), t["license"].alias("license"), (-hit["at"]).alias("minus_start"), (hit["at"] + F.size(span)).alias("end"))

            return F.transform(F.array(t["n"], t["n"] + F.ceil(t["n"] / 4).cast("int")), window)

        return F.flatten(F.transform(F.filter(table, lambda t: F.array_contains(t["grams"], hit["gram"])), of))

    matching = F.filter(F.flatten(F.transform("hits", lambda h: F.filter(windows(h), lambda w: w["dice"] >= threshold))), lambda w: w.isNotNull())
    apart = F.aggregate(
        F.sort_array(matching, asc=False),
        F.filter(matching, lambda w: F.lit(False)),
        lambda chosen, w: F.when(F.exists(chosen, lambda c: (-w["minus_start"] < c["end"]) & (-c["minus_start"] < w["end"])), chosen).otherwise(F.concat(chosen, F.array(w))),
    )
    # pair i is of words i and i + 1, so that a window's words after the first end at word ``end``
    counted = F.filter(apart, lambda w: ~F.exists(F.slice("breaks", 2, F.size("breaks")), lambda x: x) | F.exists(F.slice("breaks", 2 - w["minus_start"], w["end"] + w["minus_start"]), lambda x: x))
    return F.transform(counted, lambda w: F.struct(w["dice"].alias("dice"), w["license"].alias("license")))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licences that each document of ``docs`` (``doc_id``, ``text``) states.

    Returns ``doc_id, license, dice, n_units``: a row for each document and
    licence with the best coefficient and the number of lines and paragraphs
    (of several lines, parted by lines without a word) that match, and of
    windows that match in other lines or reach over the line feeds of other
    paragraphs. Windows of a unit don't overlap; the best go first. Of several
    licences the one with the best coefficient counts for a unit, then the last
    by name. Words are lower-cased runs of letters and digits. A null or empty
    text, or one without a match, has no row; rows of equal ``doc_id`` are
    counted together.
    """
    known = template_bigrams(templates)
    sizes = [len(grams) for _, grams in known]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams")) for name, grams in known])
    plain = docs.select("doc_id", F.regexp_replace(F.lower("text"), _NOT_WORD, " ").alias("plain"))
    paragraphs = F.filter(F.split("plain", r"\n *\n"), lambda p: p.contains("\n"))
    units = plain.select("doc_id", F.explode(F.concat(F.split("plain", r"\n"), paragraphs)).alias("unit"))
    # a gram has three characters at least; the gate leaves few units to be cut up
    units = units.where(F.length("unit") >= 2 * min(sizes) * low).where(F.arrays_overlap(F.split("unit", r"[ \n]"), F.array(*map(F.lit, gate_words(templates, threshold)))))
    # the first word of a line keeps its line feed until the breaks are known
    marked = F.filter(F.split(F.regexp_replace("unit", r" *\n *", " \n"), " "), lambda w: F.trim(F.translate(w, "\n", " ")) != "")
    units = units.select("doc_id", marked.alias("marked"))
    units = units.select("doc_id", F.transform("marked", lambda w: w.startswith("\n")).alias("breaks"), F.transform("marked", lambda w: F.translate(w, "\n", "")).alias("words"))
    words = F.col("words")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    units = units.select("doc_id", "breaks", pairs.alias("pairs"))
    every = sorted({g for _, grams in known for g in grams})
    hits = F.filter(F.transform("pairs", lambda g, i: F.struct(g.alias("gram"), i.alias("at"))), lambda h: h["gram"].isin(every))
    units = units.withColumn("hits", hits).where(F.size("hits") >= min(sizes) * low)
    units = units.withColumn("grams", F.array_distinct("pairs")).withColumn("n", F.size("grams"))
    candidates = F.filter(table, lambda t: (F.col("n") >= t["n"] * low) & (F.col("n") <= t["n"] * high))
    scored = F.transform(
        candidates,
        lambda t: F.struct((F.size(F.array_intersect(F.col("grams"), t["grams"])) * 2.0 / (F.col("n") + t["n"])).alias("dice"), t["license"].alias("license")),
    )
    units = units.withColumn("best", F.array_max(scored))
    whole = F.coalesce(F.col("best.dice") >= threshold, F.lit(False))
    found = F.when(whole, F.array("best")).otherwise(_in_windows(table, threshold))
    best = units.select("doc_id", F.explode(found).alias("best"))
    return best.groupBy("doc_id", F.col("best.license").alias("license")).agg(F.round(F.max("best.dice"), 6).alias("dice"), F.count("*").alias("n_units"))
