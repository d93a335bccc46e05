"""License scans: TF-IDF cosine of statements, headers and licence files to templates, and inheritance by directory.

Passages are scored where their text lies, by array functions over its terms;
only directories and their licences meet in joins.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.plans.scratch import materialize

# SPDX identifiers with the wording by which the licences are stated or given in full.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # How the full texts open, or all of a short one.
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989 Copyright (C) 1989 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002 Copyright (C) 2000, 2001, 2002 Free Software Foundation, Inc. 51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc. https://fsf.org/ Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions. 1.0.1. Commercial Use means distribution or otherwise making the Covered Code available to a third party."),
)
#: A passage without any of these word beginnings states no licence.
ANCHORS = ("licen", "unlicense", "copyright", "permission", "redistribut", "free software", "source code", "public domain", "creative commons")
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"
THRESHOLD = 0.7
TERM = r"[\p{L}\p{N}]+"
#: What comments put before and after their lines.
COMMENT_MARK = r"^[ \t\r]*(?:/[*/]+|[*#;%!]+|--+|<!--+|\"\"\"|\(\*)?[ \t]*|[ \t]*(?:\*+[/)]|--+>|\"\"\")?[ \t\r]*$"
#: Passages are single lines, and so many paragraphs in a row.
WINDOWS = (1, 2, 3, 6)

_SORTED = sorted({licence for licence, _ in TEMPLATES})


def template_weights() -> tuple[dict[str, float], list[tuple[str, dict[str, float]]], float]:
    """(idf by term; for each template its licence and idf * weight / norm by term; the idf of a term in none), by the templates alone."""
    counts = [Counter(re.findall(r"[a-z0-9]+", text.lower())) for _, text in TEMPLATES]
    n = len(TEMPLATES)
    held = Counter(t for c in counts for t in c)
    idf = {t: math.log((1.0 + n) / (1.0 + k)) + 1.0 for t, k in held.items()}
    norms = [math.sqrt(sum((tf * idf[t]) ** 2 for t, tf in c.items())) for c in counts]
    shares = [(licence, {t: idf[t] * tf * idf[t] / norm for t, tf in c.items()}) for (licence, _), c, norm in zip(TEMPLATES, counts, norms)]
    return idf, shares, math.log(1.0 + n) + 1.0


def _map(pairs: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def passage_score(passage: Column, threshold: float = THRESHOLD) -> Column:
    """struct(score, order): the best cosine of a passage to a template, and its licence by place from the end of the names in order; null if none reaches ``threshold``.

    Term weights are term frequency times the idf among the templates; terms in
    none of them count for the passage's norm. Of equal cosines the first
    licence in order of name counts. A passage without terms scores 0.
    """
    idf, shares, unseen = template_weights()
    own_idf = _map(idf)
    terms = F.regexp_extract_all(F.lower(passage), F.lit(TERM), F.lit(0))

    def with_terms(terms: Column) -> Column:
        # Equal terms stand together: the sum of squared frequencies in one run over them.
        start = F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("squares"))
        step = lambda a, t: F.when(a["term"] == t, F.struct(t.alias("term"), (a["run"] + 1).alias("run"), (a["squares"] + 2 * a["run"] + 1).alias("squares"))).otherwise(F.struct(t.alias("term"), F.lit(1).cast("long").alias("run"), (a["squares"] + 1).alias("squares")))
        squares = F.aggregate(F.array_sort(terms), start, step, lambda a: a["squares"])
        known = F.transform(F.array_intersect(terms, F.array(*map(F.lit, idf))), lambda t: F.struct(t.alias("term"), F.size(F.filter(terms, lambda x: x == t)).cast("double").alias("tf"), own_idf[t].alias("idf")))

        def with_known(known: Column) -> Column:
            sums = lambda f: F.aggregate(known, F.lit(0.0), lambda a, k: a + k["tf"] * k["tf"] * f(k["idf"]))
            inside = sums(lambda idf: idf * idf)
            norm = F.sqrt(squares * (unseen * unseen) + sums(lambda idf: idf * idf - unseen * unseen))
            dot = lambda share: F.aggregate(known, F.lit(0.0), lambda a, k: a + k["tf"] * F.coalesce(share[k["term"]], F.lit(0.0)))
            each = F.array(*[F.struct(F.lit(len(_SORTED) - _SORTED.index(licence)).alias("order"), _map(share).alias("share")) for licence, share in shares])
            scored = F.array_max(F.transform(each, lambda t: F.struct(F.round(dot(t["share"]) / norm, 6).alias("score"), t["order"].alias("order"))))
            # No cosine is above the share of the norm that words of templates have, which spares most passages the templates.
            return F.when((F.sqrt(inside) / norm > threshold - 1e-6) & (scored["score"] >= threshold), scored)

        return F.transform(F.array(known), with_known)[0]

    return F.transform(F.array(terms), with_terms)[0]


def passages_of(text: Column, whole: Column) -> Column:
    """The passages of a text that may state a licence: its lines, and paragraphs in a row with comment marks taken off; the whole text if ``whole``."""
    anchor = "(?i)" + "|".join(ANCHORS)
    bare = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, COMMENT_MARK, "")), "\n")
    paragraphs = F.transform(F.split(bare, "\n\n+"), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))

    def in_a_row(ps: Column, k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(ps) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(ps, i, k), " "))

    def with_paragraphs(ps: Column) -> Column:
        return F.concat(*(in_a_row(ps, k) for k in WINDOWS))

    several = F.transform(F.array(paragraphs), with_paragraphs)[0]
    found = F.concat(F.split(text, "\n"), several, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")))
    found = F.filter(F.array_distinct(found), lambda p: p.rlike(anchor))
    return F.when(text.rlike(anchor), found).otherwise(F.array().cast("array<string>"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", licence_file: Column | None = None, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, licence, score, basis, licence_dir) of every row of ``files(path, text)``, and its columns ``keep``.

    Every line of a text is a passage, and so are up to six paragraphs in a
    row, comment marks taken off, and the whole text of a licence file (by name,
    or where ``licence_file`` holds). A row's own licence is that of its best
    passage (basis ``own``). A row without one takes the licence of the nearest
    directory above it that has a licence file (``inherited``), else none. Of
    several licence files in a directory the best counts, then the first
    licence in order of name. A null text has no passage, a row with a null path
    no directory; very long texts are read whole; repeated rows, and different
    texts at one path, are judged each for itself; other columns are ignored; an
    empty table gives an empty result.
    """
    named = F.col("path").rlike(LICENCE_FILE) if licence_file is None else licence_file
    held = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), *held).withColumn("is_licence", F.coalesce(named, F.lit(False)))
    best = F.array_max(F.transform(passages_of(F.col("text"), F.col("is_licence")), lambda p: passage_score(p, threshold)))
    names = F.array(*map(F.lit, reversed(_SORTED)))
    given = lambda c: F.struct(F.element_at(names, c["order"]).alias("licence"), c["score"].alias("score"), c["order"].alias("order"))
    rows = rows.withColumn("best", best).drop("text").withColumn("own", F.when(F.col("best").isNotNull(), given(F.col("best")))).drop("best")
    rows = materialize(rows, "statements")

    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    licensed = rows.where("is_licence and path is not null and own is not null").groupBy(directory.alias("licence_dir")).agg(F.max(F.struct("own.score", "own.order")).alias("top"))
    licensed = licensed.select("licence_dir", given(F.col("top")).alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("licence_dir")))
    directories = rows.where("path is not null").select(directory.alias("dir")).distinct().select("dir", F.inline(above))
    nearest = directories.join(licensed, "licence_dir").groupBy("dir").agg(F.max_by(F.struct("licence_dir", "given"), "depth").alias("up"))

    joined = rows.withColumn("dir", directory).join(nearest, "dir", "left")
    basis = F.when(F.col("own").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited").otherwise("none")
    pick = lambda name: F.coalesce(F.col(f"own.{name}"), F.col(f"up.given.{name}")).alias(name)
    return joined.select("path", pick("licence"), pick("score"), basis.alias("basis"), F.when(F.col("own").isNull(), F.col("up.licence_dir")).alias("licence_dir"), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)))


def document_path(doc_id: Column, source: Column) -> Column:
    """Documents have no paths: each lies at source/id div 1000/id div 100/id, ids that 100 or 1000 divides one or two directories higher."""
    name, source = doc_id.cast("string"), F.coalesce(source, F.lit("-"))
    thousands, hundreds = (F.floor(doc_id / n).cast("string") for n in (1000, 100))
    return F.when(doc_id % 1000 == 0, F.concat_ws("/", source, name)).when(doc_id % 100 == 0, F.concat_ws("/", source, thousands, name)).when(doc_id.isNotNull(), F.concat_ws("/", source, thousands, hundreds, name))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PARAGRAPHS = f"string_split_regex(array_to_string(list_transform(string_split(text, chr(10)), lambda line: regexp_replace(line, {_quoted(COMMENT_MARK)}, '', 'g')), chr(10)), '\\n\\n+')"

#: The same over ``documents`` at their document_path, a document that opens with a statement being its directory's licence file.
LICENCE_SQL = rf"""
WITH templates AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, {_quoted(k)}, {_quoted(t)})" for i, (k, t) in enumerate(TEMPLATES))}) AS v(template, licence, passage)
), template_terms AS (
  SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest(regexp_extract_all(lower(passage), '[\p{{L}}\p{{N}}]+')) AS term FROM templates) GROUP BY ALL
), idf AS (
  SELECT term, ln({1.0 + len(TEMPLATES)} / (1.0 + count(*))) + 1.0 AS idf FROM template_terms GROUP BY term
), shares AS (
  SELECT template, licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS share FROM template_terms JOIN idf USING (term)
), files AS (
  SELECT doc_id, CASE WHEN doc_id % 1000 = 0 THEN concat_ws('/', coalesce(source, '-'), doc_id) WHEN doc_id % 100 = 0 THEN concat_ws('/', coalesce(source, '-'), doc_id // 1000, doc_id)
      WHEN doc_id IS NOT NULL THEN concat_ws('/', coalesce(source, '-'), doc_id // 1000, doc_id // 100, doc_id) END AS path,
    CASE WHEN regexp_matches(text, '(?i){"|".join(ANCHORS)}') THEN text END AS text, row_number() OVER () AS row_no,
    regexp_matches(split_part(coalesce(text, ''), chr(10), 1), '(?i){"|".join(ANCHORS)}') AS is_licence FROM documents
), cut AS (
  SELECT row_no, is_licence, text, list_transform({_PARAGRAPHS}, lambda p: replace(p, chr(10), ' ')) AS ps FROM files WHERE text IS NOT NULL
), held AS (
  SELECT DISTINCT row_no, passage FROM (
    SELECT row_no, unnest(string_split(text, chr(10))) AS passage FROM cut
    {" ".join(f"UNION ALL SELECT row_no, unnest(list_transform(range(1, greatest(len(ps) - {k - 1}, 1) + 1), lambda i: array_to_string(ps[i:i + {k - 1}], ' '))) FROM cut" for k in WINDOWS)}
    UNION ALL SELECT row_no, text FROM cut WHERE is_licence)
  WHERE regexp_matches(passage, '(?i){"|".join(ANCHORS)}')
), terms AS (
  SELECT passage, term, count(*) AS tf FROM (SELECT passage, unnest(regexp_extract_all(lower(passage), '[\p{{L}}\p{{N}}]+')) AS term FROM (SELECT DISTINCT passage FROM held)) GROUP BY ALL
), weighted AS (
  SELECT passage, term, tf * coalesce(idf, ln({1.0 + len(TEMPLATES)}) + 1.0) AS w FROM terms LEFT JOIN idf USING (term)
), norms AS (
  SELECT passage, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY passage
), scored AS (
  SELECT passage, licence, round(sum(w * share) / any_value(norm), 6) AS score
  FROM weighted JOIN shares USING (term) JOIN norms USING (passage) GROUP BY passage, template, licence
), own AS (
  SELECT row_no, licence, score FROM held JOIN scored USING (passage) WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY score DESC, licence) = 1
), placed AS (
  SELECT doc_id, path, row_no, is_licence, licence, score, regexp_replace(path, '/[^/]*$', '') AS dir FROM files LEFT JOIN own USING (row_no)
), licensed AS (
  SELECT dir AS licence_dir, licence, score FROM placed WHERE is_licence AND licence IS NOT NULL AND path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1
), nearest AS (
  SELECT d.dir, licence_dir, licence, score FROM (SELECT DISTINCT dir FROM placed WHERE path IS NOT NULL) d JOIN licensed ON licence_dir = '' OR d.dir = licence_dir OR starts_with(d.dir, licence_dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(licence_dir) DESC) = 1
)
SELECT p.path, coalesce(p.licence, n.licence) AS licence, coalesce(p.score, n.score) AS score,
  CASE WHEN p.licence IS NOT NULL THEN 'own' WHEN n.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
  CASE WHEN p.licence IS NULL THEN n.licence_dir END AS licence_dir, doc_id
FROM placed p LEFT JOIN nearest n ON n.dir = p.dir
"""
