"""License scans: TF-IDF cosine to templates, then nearest-ancestor inheritance.

DataFrame functions only. Every whole file, every block of adjacent lines (blank lines
and the end of a comment divide blocks) and every line is compared, as a TF-IDF vector,
with full licence texts, their usual notices, short headers and SPDX forms: terms weigh
by how rare they are among the templates and the cosine picks the best template. Texts
whose cosine cannot reach the least are left out beforehand, which loses nothing: those
without any of the heaviest terms of a template, and those whose bound on the dot product
(each term with its greatest weight in any template, rounded up) is too small for a bound
on their length (each word counted as if it stood once).

A file that is near a template as a whole is a licence file, as is one named like
one (LICENSE, COPYING and so on) that holds a near block or line; it licenses its
directory. Other files with a near block or line are licensed by it alone. Every
directory without a licence inherits from its nearest ancestor, by a join of the
ancestors' paths with the licensed directories; files without a licence of their own
take their directory's.

Defined results: a null or empty text has no licence; a null path has no directory, so such
a file is judged by its own text alone; a whole file goes before its parts; of equal
cosines the first licence by name wins; repeated rows get equal rows; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm.common import cut

_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
# Short headers and usual notices of common licences; the full texts are in the folder licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BSD 3-Clause License"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License, CC BY-NC 4.0."],
    "GPL-2.0": [_GNU.format("program", ";", "General Public License", ";", "2"), "GNU General Public License version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format("program", ":", "General Public License", ",", "3"), "GNU General Public License version 3, 29 June 2007"],
    "LGPL-2.1": [_GNU.format("library", ";", "Lesser General Public License", ";", "2.1"), "GNU Lesser General Public License version 2.1, February 1999"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("library", ":", "Lesser General Public License", ",", "3"), "GNU Lesser General Public License version 3, 29 June 2007"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software is granted under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"],
    "Proprietary": ["Copyright. All rights reserved. No license is granted."],
}
#: SPDX names that stand for each licence; where there are none, its own.
SPDX = {name: [f"{name}-only", f"{name}-or-later", name] for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")} | {"Proprietary": []}
TERM = r"[a-z0-9]+"
#: Words that say nothing of a licence.
STOP = tuple("a an and any are as at be for from if in is it of on or such that the this to with you".split())
LEAST_COSINE = 0.6
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[sc]es?|copying|copyright|notice)([._-][^/]*)?$"
#: Between blocks of adjacent lines: lines without a letter or digit.
BETWEEN = r"\n(?:[^A-Za-z0-9\n]*\n)+"
#: A comment's line before one that is none; and what ends a block there.
COMMENT_ENDS = r"(?m)^([ \t]*(?:#|//|/\*|\*|;|--|%|<!--).*\n)(?=[ \t]*[A-Za-z0-9_@({\[\"'])"


def all_templates() -> list[tuple[str, str]]:
    """(license, text): full texts, notices, short headers and SPDX forms."""
    full = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(resources("wayfind.llm").joinpath("licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]
    short = [(name, text) for name, texts in TEMPLATES.items() for text in texts]
    return full + short + [(name, f"SPDX-License-Identifier: {form}") for name in TEMPLATES for form in SPDX.get(name, [name])]


def _terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: ~t.isin(*STOP))


def template_terms(templates: list[tuple[str, str]]) -> tuple[list[tuple], dict[str, float], list[str]]:
    """(template, license, term, weight of a unit vector), each term's idf, and the terms of which a text must hold one to come near any template."""
    counts = [(name, Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP)) for name, text in templates]
    df = Counter(t for _, c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
    rows, needed = [], set()
    for k, (name, c) in enumerate(counts):
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        weights = sorted((n * idf[t] / length, t) for t, n in c.items())
        rows += [(k, name, t, w) for w, t in weights]
        light = 0.0
        for w, t in weights:  # the lightest terms, as many as cannot reach the least cosine together
            light += w * w
            if light >= (LEAST_COSINE - 1e-6) ** 2:
                needed.add(t)
    return rows, idf, sorted(needed)


def could_be_near(terms: Column, rows: list[tuple], idf: dict[str, float], needed: list[str], unseen: float) -> Column:
    """False only for terms whose cosine to every template is below the least."""
    levels: dict[int, list[str]] = {}
    greatest: dict[str, float] = {}
    for _, _, term, weight in rows:
        greatest[term] = max(weight, greatest.get(term, 0.0))
    for term, weight in greatest.items():
        levels.setdefault(max(-10, math.ceil(math.log(idf[term] * weight, 1.5) - 1e-9)), []).append(term)

    def among(terms: Column, some: list[str]) -> Column:
        return F.filter(terms, lambda t: t.isin(*some))

    def bound(held: Column, all_terms: Column) -> Column:
        dot = sum((F.size(among(held, some)) * (1.5**level) for level, some in sorted(levels.items())), F.lit(0.0))
        square = (F.size(all_terms) - F.size(held)) * unseen**2 + F.size(held)  # no idf is below 1
        return dot * dot >= square * (LEAST_COSINE - 1e-6) ** 2

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    return let(terms, lambda ts: F.arrays_overlap(ts, F.array(*map(F.lit, needed))) & let(among(ts, list(idf)), lambda held: bound(held, ts)))


def judge_texts(texts: DataFrame, spark: SparkSession, rows: list[tuple], idf: dict[str, float], unseen: float) -> DataFrame:
    """key, license, cosine: of texts(key, terms), those near enough to a template. Texts of one key are equal, and a repeated text has the same cosine."""
    known = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, weight double"))
    rarity = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    terms = texts.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    weighed = terms.join(rarity, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    length = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighed.filter("idf is not null").select("key", "term", "w").join(known, "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    near = dots.join(length, "key").select("key", "license", F.round(F.col("dot") / F.col("length"), 9).alias("cosine")).filter(F.col("cosine") >= LEAST_COSINE)
    best = near.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.less")).alias("cosine"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """file_id, path, license, cosine, via (header, inherited or none), source_dir: one row a file(file_id, path, text)."""
    templates = templates or all_templates()
    rows, idf, needed = template_terms(templates)
    text = F.regexp_replace("text", "\r\n?", "\n")
    unseen = math.log(1 + len(templates)) + 1
    able = F.arrays_overlap(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), F.array(*map(F.lit, needed)))
    blocks = F.split(F.regexp_replace(text, COMMENT_ENDS, "$1\n"), BETWEEN)
    unit = lambda whole: lambda x: F.struct(F.lit(whole).alias("whole"), x.alias("unit"))
    units = F.concat(F.array(unit(True)(text)), F.transform(F.array_distinct(F.concat(blocks, F.split(text, "\n"))), unit(False)))
    parts = files.filter(able).select("file_id", "path", directory(F.col("path")).alias("dir"), F.explode(units).alias("u"))
    parts = parts.filter(could_be_near(_terms(F.col("u.unit")), rows, idf, needed, unseen)).select("file_id", "path", "dir", "u.whole", _terms(F.col("u.unit")).alias("terms"))
    parts = cut(parts.withColumn("key", F.md5(F.array_join("terms", " "))))
    judged = judge_texts(parts, files.sparkSession, rows, idf, unseen)
    found = parts.drop("terms").join(judged, "key")
    own = found.groupBy("file_id", "path", "dir").agg(
        F.min(F.struct((~F.col("whole")).alias("part"), (-F.col("cosine")).alias("less"), "license")).alias("b"),
    ).select("file_id", "path", "dir", F.col("b.license").alias("license"), (-F.col("b.less")).alias("cosine"), (~F.col("b.part")).alias("whole"))
    licensed = own.filter((F.col("whole") | F.col("path").rlike(LICENSE_FILE)) & (F.col("dir") != "")).groupBy(F.col("dir").alias("source_dir")).agg(
        F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b")
    ).select("source_dir", F.col("b.license").alias("d_license"), (-F.col("b.less")).alias("d_cosine"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = files.select(directory(F.col("path")).alias("dir")).filter("dir is not null and dir <> ''").distinct().select("dir", F.explode(ancestors).alias("source_dir"))
    nearest = dirs.join(licensed, "source_dir").groupBy("dir").agg(F.max_by(F.struct("source_dir", "d_license", "d_cosine"), F.length("source_dir")).alias("n"))
    nearest = nearest.select(F.col("dir").alias("_dir"), "n.*")
    headers = own.select(F.col("file_id").alias("_id"), F.col("path").alias("_path"), "license", "cosine").distinct()
    listed = files.select("file_id", "path", directory(F.col("path")).alias("dir"))
    joined = listed.join(headers, F.col("file_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    joined = joined.join(nearest, F.col("dir") == F.col("_dir"), "left")
    header, inherited = F.col("license").isNotNull(), F.col("d_license").isNotNull()
    return joined.select(
        "file_id", "path", F.coalesce("license", "d_license").alias("license"), F.coalesce("cosine", "d_cosine").alias("cosine"),
        F.when(header, "header").when(inherited, "inherited").otherwise("none").alias("via"), F.when(~header & inherited, F.col("source_dir")).alias("source_dir"),
    )
