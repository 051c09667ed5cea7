"""License scans: TF-IDF cosine of headers and whole files to templates, then inheritance from the nearest directory.

Terms weigh by how few of the files hold them. A file is licensed by its own header, the line or block of lines nearest to a template, or by the nearest of
its directories (its own first) that holds a licence file: one whose whole text is near a template, one with the title of a licence, or one that is
named so and has a header. All of it is joins, sums and column expressions.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep

# Short public licence notices, by SPDX identifier.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
]

# The standard public texts and multi-line notices, by SPDX identifier.
TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
        ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
TEMPLATES = NOTICES + TEXTS

# The titles, with version and date, that licences of many pages stand under, by SPDX identifier.
TITLES = [
    ("GPL-1.0-only", "GNU General Public License Version 1, February 1989"),
    ("GPL-2.0-only", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0-only", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.0-only", "GNU Library General Public License Version 2, June 1991"),
    ("LGPL-2.1-only", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0-only", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0-only", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("GFDL-1.1-only", "GNU Free Documentation License Version 1.1, March 2000"),
    ("GFDL-1.2-only", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3-only", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-1.0", "Mozilla Public License Version 1.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("Artistic-1.0-Perl", "The \"Artistic License\""),
    ("Artistic-2.0", "The Artistic License 2.0"),
]
#: The least cosine of a line or block that is taken for a title: with less, another version or a sentence about the licence would do.
TITLE_SCORE = 0.9
#: Names of files that are there to hold a licence.
LICENCE_NAME = "(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
#: What stands between the blocks of a text.
BLANK_LINES = "\\n[ \\t]*\\n"
#: Blocks come after lines where scores are equal.
FIRST_BLOCK = 1 << 30
TERM = "[a-z0-9]+"


#: Added to the share of files that hold a term: the idf of a term that no file holds is then -ln(RARE), whatever their number.
RARE = 0.001


def template_terms(templates: list[tuple[str, str]]) -> list[Counter]:
    return [Counter(re.findall(TERM, text.lower())) for _, text in templates]


def term_shares(files: DataFrame, terms: list[str]) -> dict[str, float]:
    """The share of all files that hold each of the given terms, which are those of the templates: a short list."""
    held = F.array_intersect(F.expr("split(lower(coalesce(text, '')), '[^a-z0-9]+')"), F.array(*map(F.lit, terms)))
    n = files.count()
    rows = files.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    return {t: 0.0 for t in terms} | {r["term"]: r["n"] / n for r in rows}


def template_weights(templates: list[tuple[str, str]], shares: dict[str, float]) -> tuple[dict[str, float], list[dict[str, float]], float]:
    """idf of every template term over the files, each template's unit TF-IDF vector, and the idf of any other term."""
    idf = {t: -math.log((s + RARE) / (1 + RARE)) for t, s in sorted(shares.items())}
    vectors = []
    for c in template_terms(templates):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in sorted(c.items()))) or 1.0
        vectors.append({t: k * idf[t] / norm for t, k in sorted(c.items())})
    return idf, vectors, -math.log(RARE / (1 + RARE))


def anchor_terms(idf: dict[str, float], vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which a text has at least one if its cosine to one of ``vectors`` is at least ``threshold``.

    Of each template, its rarest terms (the longest of equals, since short words are common in texts), as many as leave terms whose
    vector is shorter than the threshold: without the anchors the cosine cannot reach it.
    """
    anchors = set()
    for v in vectors:
        rest = 1.0
        for t in sorted(v, key=lambda t: (-idf[t], -len(t), -v[t], t)):
            if rest < threshold**2 - 1e-9:
                break
            anchors.add(t)
            rest -= v[t] ** 2
    return sorted(anchors)


def segment_scores(files: DataFrame, templates: list[tuple[str, str]], threshold: float, titles: list[tuple[str, str]] = TITLES) -> DataFrame:
    """file_id, line (-1: the whole text; from FIRST_BLOCK on: a block of more than one line), template (number) and score of the best template
    of each segment that reaches ``threshold``, or TITLE_SCORE for titles, which have the numbers after the templates.

    Of equal scores the first template wins.
    """
    spark, n_texts = files.sparkSession, len(templates)
    templates = templates + titles
    shares = term_shares(files, sorted({t for c in template_terms(templates) for t in c}))
    idf, vectors, unknown = template_weights(templates, shares)
    least = lambda k: threshold if k < n_texts else TITLE_SCORE
    anchors = F.array(*map(F.lit, sorted({*anchor_terms(idf, vectors[:n_texts], threshold), *anchor_terms(idf, vectors[n_texts:], TITLE_SCORE)})))
    anchored = F.arrays_overlap(F.split("text", "[^a-z0-9]+"), anchors)  # one pass over a text, whatever the number of anchors
    table = spark.createDataFrame([(t, idf[t], [v.get(t, 0.0) for v in vectors]) for t in idf], "term string, idf double, w array<double>")
    held = files.select("file_id", F.lower("text").alias("text")).where(anchored)
    lines = held.select("file_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(anchored)
    blocks = held.select("file_id", F.posexplode(F.split("text", BLANK_LINES)).alias("block", "text")).where(F.col("text").contains("\n") & anchored)
    segments = lines.unionByName(held.select("file_id", F.lit(-1).alias("line"), "text")).unionByName(blocks.select("file_id", (F.col("block") + FIRST_BLOCK).alias("line"), "text"))
    terms = segments.select("file_id", "line", F.explode(F.expr(f"regexp_extract_all(text, '{TERM}', 0)")).alias("term"))
    tf = terms.groupBy("file_id", "line", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = tf.join(F.broadcast(table), "term", "left")  # the terms of the templates
    dots = [F.round(F.sum(F.col("tf") * F.col("idf") * F.col("w")[k]), 9).alias(f"dot{k}") for k in range(len(templates))]
    norm = F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(unknown)), 2)))
    summed = weighed.groupBy("file_id", "line").agg(norm.alias("norm"), *dots)
    score = lambda dot: F.round(dot / F.col("norm"), 6)
    near = [F.when(score(F.col(f"dot{k}")) >= least(k), F.struct(F.col(f"dot{k}").alias("dot"), F.lit(-k).alias("k"))) for k in range(len(templates))]
    scored = summed.select("file_id", "line", F.array_max(F.array(*near)).alias("best"), "norm").where("best is not null")
    return scored.select("file_id", "line", (-F.col("best.k")).alias("template"), score(F.col("best.dot")).alias("score"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.6, titles: list[tuple[str, str]] = TITLES) -> DataFrame:
    """The licence of every file of ``files`` (file_id, path, text).

    Returns file_id, path, license, how ('header', 'file', 'inherited' or 'none'), score and from_dir (the directory that a
    licence is inherited from). A file's header is its line, or block of lines between blank ones, of the highest score, the first of equals, lines before
    blocks; a title goes before any other. A whole text that reaches the threshold makes a licence file, as does a title (before the whole text) under any name, or a
    header in a file named LICENSE, COPYING or the like, and its directory has the licence of the one of highest score, then least path, then least file_id. Without a
    header of its own a file takes the licence of its directory or of the nearest one above. Very long texts are read to their end. Null and empty texts have no header and inherit; a null path is in the
    root directory, as is one without a slash. file_id is a key: rows repeating one with its text and path are repeated.
    An empty table gives no rows; other columns are ignored.
    """
    spdx = F.array(*(F.lit(name) for name, _ in templates + titles))
    directory = F.regexp_replace(F.coalesce("path", F.lit("")), "/?[^/]*$", "")
    files = files.select("file_id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    scores = keep(segment_scores(files, templates, threshold, titles).distinct(), "licence-scores")
    title = (F.col("template") >= len(templates)).alias("title")
    place = F.struct(title, "score", (-F.col("line")).alias("line"), "template")
    per_file = scores.groupBy("file_id").agg(
        F.max(F.when(F.col("line") >= 0, place)).alias("header"), F.max(F.when((F.col("line") < 0) | title, place)).alias("whole")
    )
    per_file = per_file.select("file_id", "header", F.struct("whole.score", "whole.template").alias("text"), F.col("whole").isNotNull().alias("is_text"))
    per_file = per_file.select("file_id", "header", F.when(F.col("is_text"), F.col("text")).alias("whole"))
    placed = files.select("file_id", "path", directory.alias("dir")).join(per_file, "file_id", "left")
    by_name = F.when(F.coalesce(F.col("path").rlike(LICENCE_NAME), F.lit(False)), F.struct("header.score", "header.template"))
    placed = placed.withColumn("whole", F.coalesce("whole", F.when(F.col("header").isNotNull(), by_name)))
    licences = placed.where("whole is not null").groupBy("dir").agg(F.min(F.struct((-F.col("whole.score")).alias("s"), "path", "file_id", F.col("whole.template").alias("template"))).alias("best"))
    licences = licences.select(F.col("dir").alias("above"), (-F.col("best.s")).alias("dir_score"), F.col("best.template").alias("dir_template"))
    parts = F.split("dir", "/")
    dirs = placed.select("dir").distinct()
    up = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("above")).distinct()
    nearest = up.join(licences, "above").groupBy("dir").agg(F.max_by(F.struct("above", "dir_score", "dir_template"), F.length("above")).alias("near"))
    out = placed.join(nearest, "dir", "left")
    how = F.when(F.col("whole").isNotNull(), "file").when(F.col("header").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    template = F.coalesce("whole.template", "header.template", "near.dir_template")
    return out.select(
        "file_id", "path", F.when(template.isNotNull(), spdx[template]).alias("license"), how.alias("how"),
        F.coalesce("whole.score", "header.score", "near.dir_score").alias("score"), F.when(how == "inherited", F.col("near.above")).alias("from_dir"),
    )
