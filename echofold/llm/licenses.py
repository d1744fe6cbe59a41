"""License scans in DataFrame functions alone.

A document's words give one 64-bit hash for each shingle.  MinHash bands over overlapping windows of shingles retrieve candidates: a
document is one if a band of any of its windows equals a band of any window of a template.  Windows are as wide as the template allows: of
WIDE shingles at every STRIDE-th place of the document against every place of the template, where it has WIDE + STRIDE - 1 or more; of one
shingle, whose MinHash is a bijection of its hash, where it has fewer.  A copy of WIDE + STRIDE - 1 shingles in a row holds one of the
template's windows whole and collides for certain; so does any shingle of a short template; a wide window of similarity J collides with probability
1 - (1 - J) ** BANDS.  Candidates are then verified: the share of a template's distinct shingles that the document holds, word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import once, side, words

SHINGLE = 5
WIDE, STRIDE, BANDS = 8, 4, 8
#: In tenths.
CONTAINMENT = 8

# The notices that are looked for.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("mit-line", "Released under the MIT License."),
    ("gpl-3-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("bsd-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]


def places(w: Column, size: int = SHINGLE) -> Column:
    """Where shingles start, from 1; a text of fewer words than a shingle has one, of no words none."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - size + 1))).otherwise(F.array().cast("array<int>"))


def hashes(w: Column, size: int = SHINGLE) -> Column:
    return F.transform(places(w, size), lambda i: F.xxhash64(*(F.get(w, i + k - 1) for k in range(size))))


def shingles(w: Column, size: int = SHINGLE) -> Column:
    return F.array_distinct(F.transform(places(w, size), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")))


def bands(h: Column, width: int, stride: int) -> Column:
    """A key for each band of each window of `width` shingles; of single shingles, all bands say the same, so there is one."""
    if width == 1:
        return F.transform(h, ordered_by(seeds()[0]))
    at = F.when(F.size(h) >= width, F.sequence(F.lit(1), F.size(h) - width + 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))

    def keys(i: Column) -> Column:
        window = F.slice(h, i, F.lit(width))
        return F.array(*(F.array_min(F.transform(window, ordered_by(seed))) for seed in seeds()))

    return F.flatten(F.transform(at, keys))


def ordered_by(seed: int):
    return lambda x: x.bitwiseXOR(F.lit(seed))


def seeds() -> list[int]:
    """Orders of the hashes, one for each band: the odd multiples of a constant, as signed 64-bit numbers."""
    return [((k * 0x9E3779B97F4A7C15) % (1 << 64)) - (1 << 63) for k in range(1, 2 * BANDS, 2)]


def listed_sql(keys: set[int]) -> str:
    return "_k IN (" + ", ".join(f"{k}L" if k > -(1 << 63) else "bigint('-9223372036854775808')" for k in sorted(keys)) + ")"


def scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: int = CONTAINMENT) -> DataFrame:
    """doc_id, license, n_common, n_template: templates of which a document of df(doc_id, text, ...) holds at least `containment` tenths of the distinct shingles.

    Null, empty and wordless texts match nothing.  Rows without doc_id are left out; repeated rows count as one document.  Templates
    are a parameter of the job and of its size; other columns are left out.
    """
    spark = df.sparkSession
    given = spark.createDataFrame(templates, "license string, text string").withColumn("w", words(F.col("text"))).filter(F.size("w") > 0)
    given = given.select("license", hashes(F.col("w")).alias("h"), shingles(F.col("w")).alias("s"))
    wanted: dict[int, set[int]] = {1: set(), WIDE: set()}
    for r in given.select(F.size("h").alias("n"), bands(F.col("h"), 1, 1).alias("one"), bands(F.col("h"), WIDE, 1).alias("wide")).collect():  # a parameter's rows
        if r.n < WIDE + STRIDE - 1:
            wanted[1] |= set(r.one)
        else:
            wanted[WIDE] |= set(r.wide)
    rows = df.filter("doc_id IS NOT NULL").select("doc_id", once(words(F.col("text"))).alias("w"))
    rows = rows.select("doc_id", "w", once(hashes(F.col("w"))).alias("h"))
    hit = F.lit(False)
    for width, stride in ((1, 1), (WIDE, STRIDE)):
        if wanted[width]:
            rows = rows.withColumn(f"_{width}", once(bands(F.col("h"), width, stride)))
            hit = hit | F.expr(f"exists(_{width}, _k -> {listed_sql(wanted[width])})")
    found = rows.filter(hit).select("doc_id", F.explode(shingles(F.col("w"))).alias("shingle"))
    own = given.select("license", F.size("s").alias("n_template"), F.explode("s").alias("shingle"))
    both = found.join(side(own, "license", "shingle"), "shingle").groupBy("doc_id", "license", "n_template").agg(F.count_distinct("shingle").alias("n_common"))
    return both.filter(F.col("n_common") * 10 >= F.col("n_template") * containment).select("doc_id", "license", "n_common", F.col("n_template").cast("long").alias("n_template"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    rows = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in templates)
    split = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT license, {split.format("text")} AS w FROM (VALUES {rows}) v(license, text)),
ts AS (SELECT DISTINCT license, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT license, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
tn AS (SELECT license, count(*) AS n_template FROM ts GROUP BY license),
d AS (SELECT doc_id, {split.format("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))
SELECT doc_id, license, CAST(count(*) AS BIGINT) AS n_common, CAST(any_value(n_template) AS BIGINT) AS n_template
FROM ds JOIN ts USING (s) JOIN tn USING (license) GROUP BY doc_id, license HAVING count(*) * 10 >= any_value(n_template) * 8
"""
