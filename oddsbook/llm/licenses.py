"""License scans: MinHash bands over overlapping windows of shingles retrieve templates, exact shingle containment verifies them.

Everything is column expressions over a document's row, without a join or a shuffle. The templates and their bands are data: constants that Spark reads from one text
each when it plans (_constant), so that a plan does not grow with the words of the templates.
Templates are sorted by length into classes of 1, 2, 4, 8, ... shingles. A text is covered by windows of each class that
occurs, a quarter of their length apart, and a window has one minimum for each of BANDS hash orders (one order for windows
of a single shingle, whose minimum is that shingle). A window and a template that agree in one band are a candidate, so
a template with similarity s to the best window is retrieved with probability 1 - (1 - s)^BANDS: over 0.9999 for a full
copy, whose window is at most a quarter off, and over 0.99 for one with four fifths of its shingles.

A window can only agree with a template in a band if it has the template's least shingle in that band's order. So the minima are
computed for the texts that have one of these few shingles; the others have no candidates, as the minima would say too.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS_IN_SHINGLE, BANDS = 5, 8

# Notices, grants and full texts of public licenses, by a name for each.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def words_of(text: str) -> list[str]:
    """The words of a template: runs of ASCII letters and digits and of characters beyond ASCII, in lower case."""
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", text.lower())


def shingles_of(words: list[str]) -> list[str]:
    """The distinct shingles of a template; fewer words than a shingle are one."""
    return list(dict.fromkeys(" ".join(words[i : i + WORDS_IN_SHINGLE]) for i in range(max(1, len(words) - WORDS_IN_SHINGLE + 1)))) if words else []


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _starts(length: Column, stride: int = 1) -> Column:
    """Places 1, 1 + stride, ... up to length; none where it is 0."""
    return F.when(length > 0, F.sequence(F.lit(1), length, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _shingle_count(words: Column) -> Column:
    return F.when(F.size(words) == 0, 0).otherwise(F.greatest(F.lit(1), F.size(words) - (WORDS_IN_SHINGLE - 1)))


def _hashed(words: Column) -> Column:
    return F.transform(_starts(_shingle_count(words)), lambda i: F.xxhash64(F.slice(words, i, WORDS_IN_SHINGLE)))


def _order(hashes: Column, band: int, size: int) -> Column:
    """The hashes in the order of a band; a single shingle needs none."""
    return hashes if size == 1 else F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band)))


def _ranked(band: int):
    """A hash with its place in the order of a band, as a function of the hash."""
    return lambda h: F.struct(F.xxhash64(h, F.lit(band)).alias("rank"), h.alias("hash"))


def _minima(hashes: Column, size: int) -> Column:
    """The least hash of each window of that many shingles, a quarter of its length apart."""
    return hashes if size == 1 else F.transform(_starts(F.size(hashes), max(1, size // 4)), lambda s: F.array_min(F.slice(hashes, s, size)))


def _constant(value: list, kind: str) -> Column:
    """A list as one constant of a Spark type."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _looked_up(values: Column, of: dict[int, list[int]]) -> Column:
    """The templates of the band values among those of the given map from band values to templates."""
    ids = F.map_from_entries(_constant([{"v": v, "own": own} for v, own in of.items()], "array<struct<v:bigint,own:array<int>>>"))
    return F.flatten(F.transform(F.array_intersect(values, F.map_keys(ids)), lambda v: F.element_at(ids, v)))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """docs with a column licenses: an array of (license, containment, word), by name, of the templates that each whole text has.

    A template is in a text if some span of twice its shingles, beginning at one of them, has at least `least` of its
    distinct shingles; containment is the largest such share and word the number of the first word of the first span that
    has it. Words are ASCII letters, digits and characters beyond ASCII, in lower case; templates without words match nothing,
    null and empty texts have no licenses; very long texts are taken whole. Rows, repeated ones too, and other columns of any name stay
    as they are; a column licenses is replaced. A template of words, but fewer than a shingle has, is an error: no longer text could match it.
    """
    spark = docs.sparkSession
    names = sorted(TEMPLATES if templates is None else templates)
    texts = TEMPLATES if templates is None else templates
    parts = [(n, shingles_of(words_of(texts[n]))) for n in names]
    parts = [(n, s) for n, s in parts if s]
    if short := [n for n, s in parts if len(s[0].split(" ")) < WORDS_IN_SHINGLE]:
        raise ValueError(f"templates of fewer than {WORDS_IN_SHINGLE} words: {', '.join(short)}")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _words(F.col("text").cast("string")).alias("words"))
    rows = rows.withColumn("hashes", _hashed(F.col("words")))
    none = F.array().cast("array<int>")
    if not parts:
        return docs.withColumn("licenses", F.array().cast("array<struct<license:string,containment:double,word:int>>"))

    sizes = {n: 1 << (len(s) - 1).bit_length() for n, s in parts}
    classes = sorted(set(sizes.values()))
    # The bands of the templates, by the same expressions: a row for each template, a short list that the caller gave.
    small = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(parts)], "i int, shingles array<string>")
    hashes = F.transform("shingles", lambda s: F.xxhash64(F.split(s, " ")))
    minima = [F.array_min(F.transform(hashes, _ranked(b))).alias(f"b{b}") for b in range(BANDS)]
    bands = {r.i: [r.one] + [r[f"b{b}"] for b in range(BANDS)] for r in small.select("i", F.array_min(hashes).alias("one"), *minima).collect()}
    least_shingles = {x.hash for own in bands.values() for x in own[1:]} | {own[0] for i, own in bands.items() if sizes[parts[i][0]] == 1}

    rows = rows.withColumn("some", F.arrays_overlap("hashes", _constant(sorted(least_shingles), "array<bigint>")))
    rows = rows.withColumns({f"order{b}": F.when(F.col("some"), _order(F.col("hashes"), b, 2)).otherwise(F.array().cast("array<long>")) for b in range(BANDS)})
    found = []
    for size in classes:
        for band in range(1 if size == 1 else BANDS):
            of: dict[int, list[int]] = {}
            for i, (n, _) in enumerate(parts):
                if sizes[n] == size:
                    of.setdefault(bands[i][0] if size == 1 else bands[i][band + 1].rank, []).append(i)
            source = F.col("hashes" if size == 1 else f"order{band}")
            found.append(_looked_up(_minima(source, size), of))
    rows = rows.withColumn("candidates", F.when(F.col("some"), F.array_sort(F.array_distinct(F.concat(none, *found)))).otherwise(none))

    listed = _constant([{"license": n, "shingles": s} for n, s in parts], "array<struct<license:string,shingles:array<string>>>")
    words = F.col("words")

    def verified(i: Column) -> Column:
        template = F.element_at(listed, i + 1)
        length = F.size(template["shingles"])
        shingles = F.transform(_starts(_shingle_count(words)), lambda p: F.struct(p.alias("p"), F.array_join(F.slice(words, p, WORDS_IN_SHINGLE), " ").alias("s")))
        places = F.filter(shingles, lambda x: F.array_contains(template["shingles"], x["s"]))

        def best_of(hits: Column) -> Column:
            """The best span that begins at a hit: it has the next 2 * length hits at most."""
            own = lambda x, i: F.filter(F.slice(hits, i + 1, length * 2), lambda y: y["p"] < x["p"] + length * 2)
            share = lambda x, i: F.size(F.array_distinct(F.transform(own(x, i), lambda y: y["s"]))) / length
            return F.array_max(F.transform(hits, lambda x, i: F.struct(share(x, i).alias("share"), (-x["p"]).alias("p"))))

        best = F.element_at(F.transform(F.array(places), best_of), 1)  # the hits are made once, as a bound variable
        return F.struct(template["license"].alias("license"), best["share"].alias("containment"), (-best["p"] - 1).alias("word"))

    licenses = F.filter(F.transform("candidates", verified), lambda x: x["containment"] >= least)
    return rows.withColumn("licenses", licenses).select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "licenses"), "licenses")

