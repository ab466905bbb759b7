"""Operator 2, license scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklattice.llm._util import as_table

# The notices by which well-known licenses are named.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def seed(j: int) -> int:
    """The seed of the j-th hash function."""
    return (0x5BD1E995 + 0x61C88647 * j) & 0x7FFFFFFF


def normal_words(text: str) -> list[str]:
    """Runs of a-z and 0-9 of the lower-cased text; the same as words() below."""
    return re.findall("[a-z0-9]+", text.lower())


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bands_for(similarity: float, miss: float = 1e-6) -> int:
    """Bands of one row that leave a pair of that Jaccard similarity without a collision with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def anchors(templates: Mapping[str, str], shingle: int, containment: float) -> list[str]:
    """Words of which every text holds one that can contain a template: for each template its longest words, as the rarest,
    until they together lie in more than 1 - containment of its shingles."""
    out: set[str] = set()
    for text in templates.values():
        ws = normal_words(text)
        k = min(shingle, len(ws))
        grams = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
        met: set[tuple[str, ...]] = set()
        for w in sorted(set(ws), key=lambda w: (-len(w), w)):
            if len(met) > len(grams) * (1 - containment):
                break
            out.add(w)
            met |= {g for g in grams if w in g}
    return sorted(out)


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    containment: float = 0.8,
) -> DataFrame:
    """One row for each document and template that it contains: id, license_id, containment (the best), first_word (where
    that window begins), windows (how many hold it).

    Words are runs of a-z and 0-9 of the lower-cased text; shingles have `shingle` words, those of a shorter template
    all its words. Templates of like length are sought together: windows a quarter longer than the longest begin at
    every quarter of its length, so each occurrence lies whole in one. A window is retrieved for a template if they share the
    least value under one of the hash functions, of which there are enough to miss a window that holds `containment` of
    the shingles with probability 1e-6 at most; then the exact shares of the template's shingles decide. Windows without
    any template shingle can't collide and are not made, nor are documents split that lack every anchor word.

    Whole texts, null ones as empty; documents of one id count together (null ids too); an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    hold = "|".join(anchors(templates, shingle, containment))
    src = src.where(F.lower("text").rlike(f"(?<![a-z0-9])(?:{hold})(?![a-z0-9])")).select("doc_id", words(F.col("text")).alias("w"))
    src = as_table(src, "anchored")
    by_length: dict[tuple[int, int], dict[str, list[str]]] = defaultdict(dict)
    for name, text in templates.items():
        ws = normal_words(text)
        if ws:
            by_length[min(shingle, len(ws)), 1 << max(2, (len(ws) - 1).bit_length())][name] = ws
    found = None
    for (k, _), group in sorted(by_length.items()):
        part = _scan_group(src, group, k, containment)
        found = part if found is None else found.unionByName(part)
    return (
        found.groupBy("doc_id", "license_id")
        .agg(F.max("share").alias("containment"), F.min_by("at", F.struct(-F.col("share"), F.col("at"))).alias("first_word"), F.count(F.lit(1)).alias("windows"))
        .withColumnRenamed("doc_id", id_col)
    )


def _scan_group(src: DataFrame, group: Mapping[str, list[str]], k: int, containment: float) -> DataFrame:
    spark = src.sparkSession
    longest = max(map(len, group.values()))
    step = max(1, longest // 4)
    size = longest + step  # words of a window
    # of a window that holds enough of the shortest template, the least similarity to it
    shortest = min(map(len, group.values())) - k + 1
    similarity = containment * shortest / (size - k + 1 + (1 - containment) * shortest)
    seeds = [seed(j) for j in range(bands_for(similarity))]

    def grams(ws: Column) -> Column:
        gram = lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)])
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - k, F.lit(0))), gram)

    def bands(hs: Column) -> Column:
        least = lambda seed: F.array_min(F.transform(hs, lambda h: F.xxhash64(h, F.lit(seed))))
        return F.explode(F.array(*[F.struct(F.lit(j).alias("band"), least(s).alias("value")) for j, s in enumerate(seeds)]))

    known = spark.createDataFrame(list(group.items()), "license_id string, w array<string>").select("license_id", F.array_distinct(grams(F.col("w"))).alias("th")).collect()
    parts = sorted({h for r in known for h in r.th})  # of the fixed templates

    def around(hs: Column) -> Column:
        """The windows that hold a template shingle, as structs of at and wh, from a text's shingle hashes."""
        hit = F.filter(F.sequence(F.lit(0), F.size(hs) - 1), lambda i: F.get(hs, i).isin(parts))
        first = lambda p: F.greatest(F.lit(0), F.floor((p - size + k + step - 1) / step)).cast("int")
        starts = F.transform(hit, lambda p: F.transform(F.sequence(first(p), F.floor(p / step).cast("int")), lambda x: x * step))
        return F.transform(F.array_distinct(F.flatten(starts)), lambda at: F.struct(at.alias("at"), F.array_distinct(F.slice(hs, at + 1, size - k + 1)).alias("wh")))

    # the hashes are bound once; outer, so that the optimizer infers no filter that would make the windows a second time
    windows = src.select("doc_id", F.explode_outer(F.element_at(F.transform(F.array(grams(F.col("w"))), around), 1)).alias("x"))
    windows = windows.where("x is not null").select("doc_id", "x.at", "x.wh")
    keyed = windows.withColumn("b", bands(F.col("wh"))).select("doc_id", "at", "wh", "b.band", "b.value")
    mine = spark.createDataFrame(known, "license_id string, th array<bigint>").withColumn("b", bands(F.col("th"))).select("license_id", "th", "b.band", "b.value")
    return (
        keyed.join(F.broadcast(mine), ["band", "value"])
        .withColumn("share", F.size(F.array_intersect("wh", "th")) / F.size("th"))
        .where(F.col("share") >= containment)
        .groupBy("doc_id", "license_id", "at")
        .agg(F.max("share").alias("share"))
    )
