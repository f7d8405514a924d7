"""License scans: sparse TF-IDF cosine to templates, then inheritance along paths.

All of it is DataFrame functions. The segments of a file are its lines and its
paragraphs, and the whole text of a licence file (by its name). A template's
terms that are frequent in the corpus weigh little. Only files and segments that
hold one of a template's anchors - its heaviest terms, without which a segment
can't reach the threshold - are broken into terms; a file's segments are scored
in place, so that only its best match is ever shuffled.

A file without a match of its own takes the licence of the nearest directory
above it (or its own directory) that has a licence file with a match.

Defined results: null and empty texts match nothing and inherit; repeated rows
give a row each (ids should be unique: rows of one id share their best match);
ties go to the smaller licence name; null paths inherit nothing; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

THRESHOLD = 0.7
#: Weight of terms that no template has.
OTHER = 2.0
#: Parts that one ancestor's directories are dealt to.
SALT = 16
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
_SPLIT = r"[^a-z0-9.+-]+|\.+(?![0-9a-z])"

#: Licence notices as they are commonly written.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is free software; licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "Copyright. All rights reserved. Confidential and proprietary"),
)


def terms(text: str) -> list[str]:
    return [t for t in re.split(_SPLIT, text.lower()) if t]


def _weights(idf: dict[str, float], templates: tuple[tuple[str, str], ...]) -> list[tuple[int, str, dict[str, float]]]:
    """(number, licence, unit vector) of each template."""
    out = []
    for k, (name, text) in enumerate(templates):
        tf: dict[str, float] = {}
        for t in terms(text):
            tf[t] = tf.get(t, 0) + idf[t]
        norm = math.sqrt(sum(v * v for v in tf.values()))
        out.append((k, name, {t: v / norm for t, v in tf.items()}))
    return out


def anchors(vectors: list[tuple[int, str, dict[str, float]]], threshold: float) -> list[str]:
    """Terms of which any segment at the threshold has one: without them its cosine is below it."""
    found: set[str] = set()
    for _, _, v in vectors:
        left = 1.0
        for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0])):
            if math.sqrt(max(left, 0)) < threshold - 1e-9:
                break
            found.add(t)
            left -= w * w
    return sorted(found)


def stems(found: list[str]) -> list[str]:
    """The anchors without those that hold another one: a text without any of these has no anchor."""
    return [a for a in found if not any(b != a and b in a for b in found)]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _best(s: Column, vocabulary: list[str], idf: dict[str, float], vectors: list) -> Column:
    """(s: negative cosine, license) of the best template for one segment."""
    known = F.array(*map(F.lit, vocabulary))
    weight = F.array(F.lit(OTHER), *(F.lit(idf[t]) for t in vocabulary))
    unit = F.array(*(F.array(*(F.lit(float(v.get(t, 0.0))) for _, _, v in vectors)) for t in vocabulary))
    names = F.array(*(F.lit(name) for _, name, _ in vectors))

    def of_runs(runs: Column) -> Column:
        norm = F.sqrt(F.aggregate(runs, F.lit(0.0), lambda a, r: a + r["w"] * r["w"]))
        dots = F.aggregate(F.filter(runs, lambda r: r["at"] > 0), F.array_repeat(F.lit(0.0), len(vectors)), lambda a, r: F.zip_with(a, F.get(unit, r["at"] - 1), lambda x, u: x + u * r["w"]))
        return _let(norm, lambda n: F.array_min(F.zip_with(dots, names, lambda d, name: F.struct((-F.round(d / n, 6)).alias("s"), name.alias("license")))))

    def of_ends(w: Column, ends: Column) -> Column:
        # equal terms lie together: a run's length is its term's frequency
        counted = F.transform(ends, lambda e, k: F.struct(F.get(w, e).alias("t"), (e - F.coalesce(F.when(k > 0, F.get(ends, k - 1)), F.lit(-1))).alias("tf")))
        placed = F.transform(counted, lambda r: F.struct(F.array_position(known, r["t"]).cast("int").alias("at"), r["tf"].alias("tf")))
        return _let(F.transform(placed, lambda r: F.struct(r["at"].alias("at"), (r["tf"] * F.get(weight, r["at"])).alias("w"))), of_runs)

    def of_words(w: Column) -> Column:
        last = F.size(w) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(w, i) != F.get(w, i + 1)))
        return _let(F.when(last >= 0, ends).otherwise(F.array().cast("array<int>")), lambda e: of_ends(w, e))

    return _let(F.array_sort(F.filter(F.split(s, _SPLIT), lambda x: x != "")), of_words)


def matches(files: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, score): the best match of each file with one."""
    vocabulary = sorted({t for _, text in templates for t in terms(text)})
    low = F.lower("text")
    df = files.select(F.explode(F.array_intersect(F.split(low, _SPLIT), F.array(*map(F.lit, vocabulary)))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counts = {r.term: r.n for r in df.collect()}  # a row for each template term at most
    n_files = files.count()
    idf = {t: math.log((1 + n_files) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}
    vectors = _weights(idf, templates)
    needed = stems(anchors(vectors, threshold))

    def held(s: Column) -> Column:
        return reduce(lambda a, b: a | b, (F.contains(s, F.lit(x)) for x in needed))

    name = F.element_at(F.split("path", "/"), -1)

    def segments(text: Column) -> Column:
        whole = F.when(name.rlike(LICENSE_FILE), F.array(text)).otherwise(F.array().cast("array<string>"))
        paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
        return F.array_distinct(F.filter(F.concat(F.split(text, "\n"), paragraphs, whole), held))

    found = _let(low, lambda text: F.when(held(text), F.array_min(F.transform(segments(text), lambda s: _best(s, vocabulary, idf, vectors)))))
    rows = files.select("doc_id", found.alias("b")).where(F.col("b.s") <= -threshold)
    best = rows.groupBy("doc_id").agg(F.min("b").alias("b"))
    return best.select("doc_id", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, license, from_dir): the nearest of each directory's ancestors, itself included, that `licensed` (dir, license) has."""
    parts = F.split("dir", "/")
    above = directories.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select("dir", "depth", F.concat_ws("/", F.slice(parts, F.lit(1), F.col("depth"))).alias("from_dir"))
    # a source's top directory is above a large share of all others: dealt to SALT parts
    above = above.withColumn("part", F.pmod(F.xxhash64("dir"), F.lit(SALT)))
    one = licensed.groupBy(F.col("dir").alias("from_dir")).agg(F.min("license").alias("license")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    near = above.join(one, ["from_dir", "part"]).groupBy("dir").agg(F.max(F.struct("depth", "license", "from_dir")).alias("n"))
    return near.select("dir", "n.license", "n.from_dir")


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, license, score, origin): origin is "own", "inherited" or null."""
    rows = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    own = checkpointed(matches(rows, threshold))
    named = rows.select("doc_id", "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"))
    joined = named.join(own, "doc_id", "left")
    sources = named.where(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE)).join(own, "doc_id").select("dir", "license")
    of_dir = inherited(named.where("dir is not null").select("dir").distinct(), sources).select("dir", F.col("license").alias("above"))
    out = joined.join(of_dir, "dir", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("above").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce("license", "above").alias("license"), "score", origin.alias("origin"))
