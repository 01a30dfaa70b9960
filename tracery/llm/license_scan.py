"""Licences of files: TF-IDF cosine of their headers and texts to templates, then the nearest directory's licence file."""

from __future__ import annotations

import json
import math
import re
from functools import partial
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stash, table

_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
#: Statements by which files declare a licence, titles and texts of licences, by SPDX id.
TEMPLATES = {
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007", _GNU.format("program", "Affero", "3")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "BSD-2-Clause": ["Use of this source code is governed by a BSD 2 clause simplified license", "BSD 2-Clause License", _BSD.format("")],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD 3 clause style license that can be found in the LICENSE file", "BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"),
    ],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License CC BY 4.0", "Creative Commons Attribution 4.0 International", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-SA-4.0": ["Licensed under CC BY SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC0-1.0": ["To the extent possible under law the author has waived all copyright and related rights to this work CC0 1.0 Universal public domain dedication", "Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991", _GNU.format("program", "", "2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007", _GNU.format("program", "", "3")],
    "ISC": [
        "ISC License",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999", _GNU.format("library", "Lesser", "2.1")],
    "LGPL-3.0": ["This library is free software licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License Version 3, 29 June 2007", _GNU.format("library", "Lesser", "3")],
    "MIT": [
        "Released under the MIT License", "The MIT License (MIT)",
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_NO_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": ["zlib License", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
}
#: Least cosine at which a text counts as a statement of a licence.
THRESHOLD = 0.6
#: Weight of a term that all templates have.
LEAST_WEIGHT = 0.2
#: Terms of a template that a text must hold at least where no single one tells.
SEVERAL = 7
#: Words of any prose, which are the last to serve as anchors.
_COMMON = set("a an and any any at be by can copy either even file for form found free from has in into is it its may not of on one or see so than that the this to under use was who will with without work you your".split())
#: What lies between paragraphs: two ends of lines at least, and no letter or digit.
_GAP = r"\n[^A-Za-z0-9]*\n"


def with_tags(templates: dict[str, list[str]]) -> dict[str, list[str]]:
    """Templates with the SPDX tag of each licence."""
    return {name: [*texts, f"SPDX-License-Identifier: {name}"] for name, texts in templates.items()}


def template_weights(templates: dict[str, list[str]]) -> tuple[list[tuple[str, int, str, float, float]], float]:
    """(licence, template, term, weight / norm, weight) of every term, and the weight of terms that no template has."""
    terms = [(name, set(re.findall("[a-z0-9]+", text.lower()))) for name, texts in templates.items() for text in texts]
    df: dict[str, int] = {}
    for _, own in terms:
        for t in own:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + len(terms)) / (1 + n)) + LEAST_WEIGHT for t, n in df.items()}
    rows = []
    for k, (name, own) in enumerate(terms):
        norm = math.sqrt(sum(idf[t] ** 2 for t in own))
        rows += [(name, k, t, idf[t] / norm, idf[t]) for t in sorted(own)]
    return rows, math.log(1 + len(terms)) + LEAST_WEIGHT


def needed_terms(weights: list[tuple[str, int, str, float, float]], threshold: float) -> tuple[list[str], list[tuple[dict[str, float], int]]]:
    """What a text must hold if any part of it reaches the threshold: one of the anchors, or of some list at least so
    many terms, whose squared shares make up the threshold. A part's cosine to a template is at most the root of the squared shares of the template's terms in it, so
    without an anchor the other terms must make up the threshold: none can, or only SEVERAL and more together."""
    left: dict[int, dict[str, float]] = {}
    for _, k, term, share, _ in weights:
        left.setdefault(k, {})[term] = share**2
    least = threshold**2 - 1e-9

    def needed(own):
        sums = list(accumulate(sorted(own.values(), reverse=True)))
        return 1 + sum(x < least for x in sums) if sums and sums[-1] >= least else 0

    anchors: list[str] = []
    while open_ := [own for own in left.values() if 0 < needed(own) < SEVERAL]:
        gain: dict[str, float] = {}
        for own in open_:
            for term, value in own.items():
                gain[term] = gain.get(term, 0) + value * (0.001 if term in _COMMON or term.isdigit() else 1)
        anchors.append(max(sorted(gain), key=gain.__getitem__))
        for own in left.values():
            own.pop(anchors[-1], None)
    return anchors, [(own, needed(own)) for own in left.values() if needed(own)]


def _terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")), "")


def license_scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, own_license, own_score, license, inherited_from) for each distinct path of ``files`` (path, text).

    Every line, every paragraph (lines joined up to one without letters or digits) and the whole text of
    every file is compared with each template of each licence, and with its SPDX tag, by cosine of TF-IDF
    vectors (a term counts once a text; terms outside the templates weigh most). The licence of the best
    one at ``threshold`` or more is the file's own; ties go to the licence with the larger sum over the file's
    lines, paragraphs and whole text, then to the smaller name. A file without one takes the licence of the
    nearest directory above it, its own included, that has a licence file (LICENSE*, LICENCE*, COPYING*) of a
    licence that was found; other licence files are passed over; of several in a directory the smallest path
    counts. Texts that hold too few of the templates' terms, and units of which too few terms are template terms, are
    passed over by exact bounds. Null and empty texts have no licence of their own; rows without a path are
    dropped, as there is no file to report; rows that repeat a path count as one file; an
    empty table gives no rows. Only DataFrame functions are used. Directories are resolved once
    each, however many files they hold.
    """
    spark = files.sparkSession
    weights, unknown = template_weights(with_tags(templates))
    known = spark.createDataFrame(weights, "name string, template int, term string, share double, idf double")
    most = max(w[4] for w in weights)
    anchors, lists = needed_terms(weights, threshold)

    def literal(terms):
        return F.split(F.lit(" ".join(sorted(terms))), " ")  # one constant, however many terms

    vocabulary = literal({w[2] for w in weights})

    rows = files.where("path is not null").select(F.col("path").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    named = F.regexp_extract("path", "[^/]*$", 0).rlike("^(LICENSE|LICENCE|COPYING)")

    def enough(met: Column) -> Column:
        found = F.arrays_overlap(met, literal(anchors)) if anchors else F.lit(False)
        for shares, n in lists:
            total = F.aggregate(F.transform(met, partial(F.element_at, F.from_json(F.lit(json.dumps(shares)), "map<string,double>"))), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
            found |= (F.size(met) >= n) & (F.size(F.array_intersect(met, literal(shares))) >= n) & (total >= threshold**2 - 1e-6)
        return found

    # inside exists and transform a text's terms are found once, however often they are named
    some = rows.where(F.exists(F.array(F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+"), vocabulary)), enough))
    parts = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", _GAP), F.array("text")))
    terms = F.transform(F.transform(parts, _terms), lambda t: F.struct(F.xxhash64(F.sort_array(t)).alias("unit"), F.size(t).alias("n"), F.array_intersect(t, vocabulary).alias("met")))
    # the outer form, as the other one would make the terms once more to leave out empty lists
    units = some.select("path", F.explode_outer(terms).alias("u")).select("path", "u.unit", "u.met", (F.col("u.n") - F.size("u.met")).alias("rest"))
    units = units.where((F.size("met") > 0) & (F.size("met") * (most**2 * (1 - threshold**2)) >= F.col("rest") * (threshold**2 * unknown**2) - 1e-9))
    units = stash(units, "units").dropDuplicates(["path", "unit"])
    terms = units.select("path", "unit", "rest", F.explode("met").alias("term"))
    # as many rows as the templates have terms
    dots = terms.join(F.broadcast(known), "term")
    norms = terms.join(F.broadcast(known.select("term", "idf").distinct()), "term").groupBy("path", "unit", "rest").agg(F.sum(F.col("idf") * F.col("idf")).alias("inside"))
    norms = norms.select("path", "unit", F.sqrt(F.col("inside") + F.col("rest") * (unknown**2)).alias("norm"))
    dots = dots.groupBy("path", "unit", "name", "template").agg(F.sum(F.col("idf") * F.col("share")).alias("dot"))
    scores = dots.groupBy("path", "unit", "name").agg(F.max("dot").alias("dot")).join(norms, ["path", "unit"])
    scores = scores.select("path", "name", F.round(F.col("dot") / F.col("norm"), 4).alias("score")).where(F.col("score") >= threshold)
    found = scores.groupBy("path", "name").agg(F.max("score").alias("score"), F.round(F.sum("score"), 3).alias("total"))
    own = found.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("score"), (-F.col("total")).alias("total"), "name")).alias("best"))
    own = stash(own.select("path", F.col("best.name").alias("own_license"), (-F.col("best.score")).alias("own_score")), "own")

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    held = own.where(named).withColumn("folder", folder)
    held = stash(held.groupBy("folder").agg(F.min(F.struct("path", "own_license")).alias("first")).select("folder", F.col("first.own_license").alias("license")), "folders")
    distinct = rows.select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = distinct.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("above")).distinct()
    nearest = above.join(small(held.withColumnRenamed("folder", "above")), "above").groupBy("folder").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "license")).alias("n"))
    nearest = stash(nearest.select("folder", F.col("n.above").alias("inherited_from"), F.col("n.license").alias("given")), "nearest")

    out = rows.select("path").distinct().join(own, "path", "left").withColumn("folder", folder).join(small(nearest), "folder", "left")
    return out.select(
        "path", "own_license", "own_score", F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("inherited_from")).alias("inherited_from"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: the source is the top folder, ids give two levels below it, and every 50th is a licence file."""
    id_ = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("LICENSE-"), id_)).otherwise(F.concat(id_, F.lit(".txt")))
    level = F.concat(F.lit("/a"), (F.col("doc_id") % 7).cast("string"), F.lit("/b"), (F.col("doc_id") % 91).cast("string"), F.lit("/"))
    return docs.select("doc_id", F.concat(F.coalesce("source", F.lit("unknown")), level, name).alias("path"), "text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree."""
    files = document_files(table(spark, sf_dir, "documents"))
    found = license_scan(files)
    return found.select(F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("long").alias("doc_id"), "path", "own_license", "own_score", "license", "inherited_from")


def _sql() -> str:
    weights, unknown = template_weights(with_tags(TEMPLATES))
    values = ", ".join(f"('{n}', {k}, '{t}', {s!r}::double, {i!r}::double)" for n, k, t, s, i in weights)
    terms = "list_filter(list_distinct(regexp_split_to_array(lower({}), '[^a-z0-9]+')), lambda t: t <> '')"
    return f"""
with known(name, template, term, share, idf) as (values {values}),
files as (select doc_id, coalesce(source, 'unknown') || '/a' || (doc_id % 7) || '/b' || (doc_id % 91) || '/' ||
    case when doc_id % 50 = 0 then 'LICENSE-' || doc_id else doc_id || '.txt' end as path, coalesce(text, '') as text from documents),
units as (
  select path, unnest(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[^A-Za-z0-9]*\\n')), [text])) as unit from files),
lists as (select distinct path, list_sort({terms.format("unit")}) as terms from units),
numbered as (select row_number() over () as u, path, terms from lists),
words as (select u, path, unnest(terms) as term from numbered),
once as (select distinct term, idf from known),
norms as (select w.u, sqrt(sum(coalesce(o.idf, {unknown!r}) ^ 2)) as norm from words w left join once o on w.term = o.term group by w.u),
dots as (select w.u, w.path, k.name, k.template, sum(k.idf * k.share) as dot from words w join known k on w.term = k.term group by all),
best as (select u, path, name, max(dot) as dot from dots group by all),
scores as (select path, name, round(dot / norm, 4) as score from best join norms using (u) where round(dot / norm, 4) >= {THRESHOLD}),
found as (select path, name, max(score) as score, round(sum(score), 3) as total from scores group by all),
own as (select path, name as own_license, score as own_score from found qualify row_number() over (partition by path order by score desc, total desc, name) = 1),
placed as (select *, regexp_replace(path, '/?[^/]*$', '') as folder from files),
held as (
  select folder, own_license as given from placed join own using (path) where doc_id % 50 = 0
  qualify row_number() over (partition by folder order by path) = 1),
near as (
  select path, h.folder as inherited_from, h.given from placed p join held h on p.folder = h.folder or starts_with(p.folder, h.folder || '/') or h.folder = ''
  qualify row_number() over (partition by path order by length(h.folder) desc) = 1)
select f.doc_id, f.path, own_license, own_score, coalesce(own_license, given) as license,
  case when own_license is null then inherited_from end as inherited_from
from files f left join own using (path) left join near using (path)
"""


OP10_SQL = _sql()
