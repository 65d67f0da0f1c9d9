"""License scans with DataFrame functions only.

Sparse TF-IDF cosine of runs of adjacent lines and sentences to usual notices, and of every whole file to notices and full
license texts; files without a header of their own inherit from the license file of their nearest ancestor directory, found
by joins on directory paths.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.store import small, written

#: Usual notices, by SPDX-style name.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Proprietary", "All rights reserved."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
#: Where a text holds notices of both, the second decides: its texts hold the first's notice too.
EXTENDED = (("BSD-2-Clause", "BSD-3-Clause"),)
#: What an SPDX tag may name beside the names above.
SPDX_NAMES = ("Unlicense", "CC0-1.0", "BSL-1.0", "Zlib", "EPL-2.0", "0BSD", "LGPL-2.0", "MPL-1.1", "AFL-3.0", "Artistic-2.0")
#: Names that count only where no other license is found, as such lines stand beside other notices.
GENERIC = ("Proprietary",)

# Public license texts.
_AS_IS = """ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE"""
#: Texts that whole files are compared with, beside the notices.
FULL_TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", """MIT License Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c). {_BSD_2} {_BSD_END} {_AS_IS}"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c). {_BSD_2} {_BSD_3} {_BSD_END} {_AS_IS}"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
)
#: Licenses of which the text above is the notice for files, not the license itself.
NOTICE_ONLY = ("Apache-2.0",)
THRESHOLD = 0.7
#: From here on a whole text is nothing but a license text, whatever its file's name.
WHOLE = 0.9
#: A notice may be wrapped over so many lines and sentences.
WRAPPED = 5
#: Names of license files, whatever their ending.
_NAMES = r"(?i)(^|/)(un)?(licen[cs]e|copying)[^/]*$"
_SPDX = r"spdx-license-identifier:[ \t(]*([a-z0-9.+-]*[a-z0-9+])"
#: Runs of lines that say that a license does not hold.
_DENIED = r"\b(not|never|no longer)\s+(being\s+|been\s+|be\s+)?(re)?(released|licensed|distributed|covered|available|published|governed)\b"
_UNITS = r"\n|(?<=[.;!?])\s+"
_SPLIT = "[^a-z0-9]+"


def _tokens(text: str) -> list[str]:
    return [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if t]


def _known(templates) -> list[str]:
    return sorted({t for _, text in templates for t in _tokens(text)})


def _split(text: Column) -> Column:
    return F.filter(F.split(text, _SPLIT), lambda t: t != "")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def idf_table(files: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """Smoothed inverse document frequency over all files (lower-case text), of the templates' tokens and, under '', of any other token.

    What reaches the driver is one row for each token of the templates.
    """
    known = _known(templates)
    words = files.select(F.explode(F.array_distinct(F.split("text", _SPLIT))).alias("t")).where(F.col("t").isin(known))
    df = {r["t"]: r["n"] for r in words.groupBy("t").agg(F.count("*").alias("n")).collect()}
    total = files.count()
    return {"": math.log(1 + total) + 1.0} | {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1.0 for t in known}


def _weights(text: str, idf: dict[str, float]) -> dict[str, float]:
    """A template's vector, of length 1."""
    tf = Counter(_tokens(text))
    length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
    return {t: n * idf[t] / length for t, n in tf.items()}


def telling(idf: dict[str, float], threshold: float, templates=TEMPLATES) -> list[str]:
    """Tokens of which a text must have one to be like any template: the others, commonest first, cannot reach threshold together."""
    vectors = [_weights(text, idf) for _, text in templates]
    left = [0.0] * len(vectors)
    out = []
    for t in sorted((t for t in idf if t), key=lambda t: (idf[t], t)):
        more = [x + v.get(t, 0.0) ** 2 for x, v in zip(left, vectors, strict=True)]
        if max(more) < (threshold - 1e-3) ** 2:
            left = more
        else:
            out.append(t)
    return out


def _best(tokens: Column, hits: Column, idf: dict[str, float], templates=TEMPLATES, full_texts=()) -> Column:
    """(score, license, full) of the most similar template or full text; full: it is a license's own text."""
    norm2 = F.aggregate(F.array_distinct(hits), F.lit(0.0), lambda a, t: a + F.pow(F.size(F.filter(hits, lambda u: u == t)) * _lookup(idf, t), F.lit(2.0)))
    norm2 = norm2 + (F.size(tokens) - F.size(hits)) * F.lit(idf[""] ** 2)
    dots = [F.struct(_sum(hits, {t: w * idf[t] for t, w in _weights(text, idf).items()}).alias("dot"), F.lit(name).alias("license"), F.lit((name, text) in full_texts and name not in NOTICE_ONLY).alias("full")) for name, text in (*templates, *full_texts)]
    return _let(F.sqrt(norm2), lambda length: _let(F.array_max(F.array(*dots)), lambda m: F.struct(F.round(m["dot"] / length, 6).alias("score"), m["license"].alias("license"), m["full"].alias("full"))))


def _sum(tokens: Column, weights: dict[str, float]) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda a, t: a + _lookup(weights, t))


def _tagged(text: Column, templates) -> Column:
    """(score 1, license, full) of the first SPDX tag, its license's later versions and 'only' left aside; names beside the known ones stay in small letters."""
    names = {x.lower(): x for x in (*SPDX_NAMES, *(name for name, _ in templates))}
    tag = F.regexp_replace(F.regexp_extract(text, _SPDX, 1), r"(-only|-or-later|\+)$", "")
    name = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), tag), tag)
    return F.when(text.contains("spdx-license-identifier:") & (tag != ""), F.struct(F.lit(1.0).alias("score"), name.alias("license"), F.lit(False).alias("full")))


def _lookup(table: dict[str, float], key: Column) -> Column:
    pairs = [F.lit(x) for t, v in table.items() if t for x in (t, v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(0.0))


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES, full_texts=FULL_TEXTS) -> DataFrame:
    """One row per row of files: doc_id, path, own_license, own_score, is_license_file, inherited_from, license, origin.

    own_license: that of an SPDX tag (score 1), else of the whole text where that is like a template or full text, else of
    the up to WRAPPED adjacent lines or sentences most like a template (those without words, as of comment marks alone, do
    not count, nor do runs that deny a license), at a cosine of threshold or more (ties: the greater name; names of GENERIC
    count where there is no other; of the pairs in EXTENDED the second counts where both are there). Words of no template
    count as words of their own that no file has. A license file has a license and the name of a license file, or is
    nothing but a license's full text (cosine of WHOLE or more). Others without a license of their own take that of the
    nearest directory at or above theirs that has a license file (there, the best score decides, then the greater name).
    origin: file, header, inherited or none. Null and empty texts have no license of their own but inherit; a null path is
    the root. Repeated rows get equal results; empty tables give none; further columns are not looked at. All lines of whole
    texts are scored.
    """
    path = F.coalesce(path, F.lit(""))
    base = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.regexp_replace(path, "(^|/)[^/]*$", "").alias("dir"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    whole_ones = (*templates, *full_texts)
    idf = idf_table(base, whole_ones)
    known = _known(whole_ones)
    has = lambda x, ones: x.rlike("(^|[^a-z0-9])(" + "|".join(telling(idf, threshold, ones)) + ")($|[^a-z0-9])")
    score = lambda tokens: _let(F.filter(tokens, lambda t: t.isin(known)), lambda hits: _best(tokens, hits, idf, templates))
    lines = F.filter(F.split("text", _UNITS), lambda x: x.rlike("[a-z0-9]"))
    runs = lambda x, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, n), " "))
    runs_of = _let(lines, lambda x: F.concat(*(runs(x, n) for n in range(1, WRAPPED + 1))))
    scores = F.filter(F.transform(F.filter(runs_of, lambda x: has(x, templates) & ~x.rlike(_DENIED)), lambda x: _let(_split(x), score)), lambda m: m["score"] >= threshold)
    named = lambda x, *names: F.array_max(F.filter(x, lambda m: m["license"].isin(*names)))
    top = lambda x: F.coalesce(F.array_max(F.filter(x, lambda m: ~m["license"].isin(*GENERIC))), F.array_max(x))
    extended = lambda x, m: F.coalesce(*(F.when(m["license"] == less, named(x, more)) for less, more in EXTENDED), m)
    own = _let(scores, lambda x: _let(top(x), lambda m: extended(x, m)))
    # of a whole text, known tokens must outweigh the others, which only lengthen its vector
    outweighs = lambda tokens, hits: F.pow(_sum(hits, idf), F.lit(2.0)) >= (F.size(tokens) - F.size(hits)) * F.lit((threshold * idf[""]) ** 2)
    whole = _let(_split(F.col("text")), lambda tokens: _let(F.filter(tokens, lambda t: t.isin(known)), lambda hits: F.when(outweighs(tokens, hits), _best(tokens, hits, idf, templates, full_texts))))
    rows = base.withColumns({"part": F.when(has(F.col("text"), templates), own), "whole": F.when(has(F.col("text"), whole_ones) & ~F.col("text").rlike(_DENIED), whole)})
    more_inside = F.coalesce(reduce(or_, ((F.col("whole.license") == less) & (F.col("part.license") == more) for less, more in EXTENDED)), F.lit(False))
    rows = rows.withColumn("own", F.coalesce(_tagged(F.col("text"), whole_ones), F.when((F.col("whole.score") >= threshold) & ~more_inside, F.col("whole")), F.col("part")))
    rows = rows.select("doc_id", "path", "dir", "own", F.when(F.col("path").rlike(_NAMES) | (F.col("own.full") & (F.col("own.score") >= WHOLE)), F.col("own")).alias("file"))
    rows = written(rows, "licenses")
    at = rows.where("file is not null").groupBy("dir").agg(F.max("file").alias("file"))
    dirs = rows.select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    up = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("up")))).otherwise(above)).alias("a")).select("dir", "a.depth", "a.up")
    near = up.join(at.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "file"), "depth").alias("near"))
    rows = rows.join(small(written(near, "near")), "dir", "left")
    own_one = F.col("own")
    return rows.select(
        "doc_id", "path", own_one["license"].alias("own_license"), own_one["score"].alias("own_score"), F.col("file").isNotNull().alias("is_license_file"),
        F.when(own_one.isNull(), F.col("near.up")).alias("inherited_from"), F.coalesce(own_one["license"], F.col("near.file.license")).alias("license"),
        F.when(F.col("file").isNotNull(), "file").when(F.col("own").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
    )
