r"""Licence scan: normalised units of text against licence templates, by the Dice coefficient over word bigrams.

A text is normalised (A-Z lowered, everything but a-z, 0-9 and line ends becomes a space). Its units are its lines, its
blocks of several lines between blank lines, and its runs of 2 to RUN paragraphs (what stands between blank lines, lines
included; empty ones don't count) that have no more words than the largest template admits bigrams. So a notice of
several paragraphs is found alone and inside a file. A unit and a template with x and y distinct bigrams, z of them
common, match if 2z / (x + y) >= 0.8. That bounds x by y / 1.5 and 1.5 y: units outside every template's bounds go
before their bigrams are built, and the others meet only the templates that their size admits, by a join on the size.
The best template of a unit counts, ties going to the name that sorts first. Every run that matches has its row, so a
notice under a title may have two.

The same bound says that a match has two thirds of the template's bigrams at least. So it has one of any words that more
than a third of these bigrams touch: a text with none of a few such words, chosen over all templates, is done with.

The template table is a parameter of bounded size (a row per admitted size and template). Nothing of the documents is
shuffled. Null text has no units; a text of any length is split whole; repeated rows are scanned each. An empty table,
or one without templates, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence notices, as they are commonly written.
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT-notice": "This project is licensed under the MIT License. See the LICENSE file for details.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + BSD_END,
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_END,
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "LGPL-3.0-line": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "reserved-line": "All rights reserved.",
}

#: Paragraphs in a run, at most.
RUN = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bigrams(text: str) -> list[str]:
    words = "".join(c if c in LOWER or c in "0123456789" else " " for c in text.translate(str.maketrans(UPPER, LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _sized(templates: dict[str, str]) -> list[tuple[int, str, list[str]]]:
    """(admitted number of bigrams, name, bigrams): 2z >= 0.8 (x + y) with z <= x, y."""
    return [(x, name, b) for name, text in sorted(templates.items()) if (b := _bigrams(text)) for x in range(-(-2 * len(b) // 3), 3 * len(b) // 2 + 1)]


def needed_words(templates: dict[str, str]) -> list[str]:
    """Words of which every match of any template has one: for each template, more than a third of its bigrams touch
    them. Chosen greedily for all templates together; words
    of under five letters only where no other will do, and then such as prose doesn't have."""
    left = {name: set(b) for name, text in templates.items() if (b := _bigrams(text))}
    open_ = {name: len(b) // 3 + 1 for name, b in left.items()}
    out: list[str] = []
    while open_:
        gain: dict[str, int] = {}
        for name, need in open_.items():
            touched: dict[str, int] = {}
            for bigram in left[name]:
                for w in set(bigram.split()):
                    touched[w] = touched.get(w, 0) + 1
            for w, n in touched.items():
                gain[w] = gain.get(w, 0) + min(n, need)
        word = min(gain, key=lambda w: (len(w) < 5, len(w) < 5 and bool(set(w) & set("aeiouy0123456789")), -gain[w], w))
        out.append(word)
        for name in list(open_):
            gone = {b for b in left[name] if word in b.split()}
            left[name] -= gone
            open_[name] -= len(gone)
            if open_[name] <= 0:
                del open_[name]
    return out


def _pairs(words: Column) -> Column:
    """Distinct hashes of each two neighbours of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.xxhash64(a, b)))


def _once(column: Column, name: str) -> Column:
    """As a row generator of one element, so that a column with many uses is computed once."""
    return F.explode(F.array(column)).alias(name)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each unit that matches: doc_id, unit ('line', 'block' or 'run'), unit_no (from 0; of a run, the place of
    its first paragraph), n_paragraphs (1 unless a run), n_bigrams, license_id and dice (six decimals)."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    sized = [(x, name, [b.split() for b in bigrams]) for x, name, bigrams in _sized(templates)]
    least, most = (min(x for x, *_ in sized), max(x for x, *_ in sized)) if sized else (1, 0)
    admitted = (
        spark.createDataFrame(sized, "n_bigrams int, name string, bigrams array<array<string>>")
        .select("n_bigrams", "name", F.transform("bigrams", lambda b: F.xxhash64(b[0], b[1])).alias("bigrams"))
        .groupBy("n_bigrams").agg(F.sort_array(F.collect_list(F.struct("name", "bigrams"))).alias("templates"))
    )
    lowered = docs.select("doc_id", _once(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), "low"))
    any_word = F.lit(False)
    for word in needed_words(templates):
        any_word = any_word | F.contains("low", F.lit(word))
    norm = F.regexp_replace("low", r"[^a-z0-9\n]+", " ")
    unit = lambda kind, no, n, words: F.struct(F.lit(kind).alias("unit"), no.alias("unit_no"), n.alias("n_paragraphs"), words.alias("words"))
    one = F.lit(1)
    lines = F.transform(F.split("norm", "\n"), lambda x, i: unit("line", i, one, F.trim(x)))
    several = F.regexp_like("norm", F.lit(r"\n *\n"))  # else the whole text is the one block
    parts = F.when(several, F.split("norm", r"\n[ \n]*\n")).otherwise(F.array("norm"))
    flat = lambda x: F.trim(F.regexp_replace(x, r"[ \n]+", " "))
    blocks = F.transform(parts, lambda x, i: unit("block", i, one, x))
    blocks = F.filter(blocks, lambda s: F.regexp_like(s["words"], F.lit(r"[a-z0-9] *\n[ \n]*[a-z0-9]")))
    blocks = F.transform(blocks, lambda s: unit("block", s["unit_no"], one, flat(s["words"])))
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    paragraphs = F.transform(F.filter(F.transform(parts, flat), lambda x: x != ""), lambda x: F.struct(x.alias("x"), (spaces(x) + 1).alias("n")))
    texts = lowered.where(any_word).select("doc_id", _once(norm, "norm"))
    texts = texts.select("doc_id", "norm", _once(F.when(several, paragraphs).otherwise(F.array().cast("array<struct<x:string,n:int>>")), "p"))
    some = lambda i, n: F.slice("p", i + 1, n)
    words_in = lambda i, n: F.aggregate(some(i, n), F.lit(0), lambda total, q: total + q["n"])
    lengths = lambda i: F.filter(F.sequence(F.lit(2), F.least(F.lit(RUN), F.size("p") - i)), lambda n: words_in(i, n).between(least + 1, most + 1))
    starts = F.when(F.size("p") > 1, F.sequence(F.lit(0), F.size("p") - 2)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda n: unit("run", i, n, F.array_join(F.transform(some(i, n), lambda q: q["x"]), " ")))))
    units = texts.select("doc_id", F.inline(F.filter(F.concat(lines, blocks, runs), lambda s: spaces(s["words"]) >= least)))
    words = units.select("doc_id", "unit", "unit_no", "n_paragraphs", _once(F.split("words", " "), "w"))
    # However many words a unit has, its bigrams are built once; only an admitted number of them is compared.
    built = words.select("doc_id", "unit", "unit_no", "n_paragraphs", _once(_pairs(F.col("w")), "b")).withColumn("n_bigrams", F.size("b")).where(F.col("n_bigrams").between(least, most))
    met = built.join(F.broadcast(admitted), "n_bigrams")
    scored = F.transform("templates", lambda t: F.struct(F.size(F.array_intersect(F.col("b"), t["bigrams"])).alias("common"), F.size(t["bigrams"]).alias("of"), t["name"].alias("name")))
    good = F.filter(scored, lambda s: 10 * s["common"] >= 4 * (F.col("n_bigrams") + s["of"]))
    ranked = F.transform(good, lambda s: F.struct((-F.round(2.0 * s["common"] / (F.col("n_bigrams") + s["of"]), 6)).alias("less"), s["name"].alias("name")))
    return met.select("doc_id", "unit", "unit_no", "n_paragraphs", "n_bigrams", _once(F.array_min(ranked), "best")).where("best IS NOT NULL").select("doc_id", "unit", "unit_no", "n_paragraphs", "n_bigrams", F.col("best.name").alias("license_id"), (-F.col("best.less")).alias("dice"))


def _sql() -> str:
    sized = _sized(TEMPLATES)
    least, most = min(x for x, *_ in sized), max(x for x, *_ in sized)
    values = ", ".join(f"('{name}', [{', '.join(repr(b) for b in _bigrams(text))}])" for name, text in sorted(TEMPLATES.items()))
    return f"""
WITH t(name, bigrams) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g') AS norm FROM documents),
l AS (SELECT doc_id, unnest(string_split(norm, chr(10))) AS x, unnest(range(len(string_split(norm, chr(10))))) AS unit_no FROM d),
k AS (SELECT doc_id, unnest(string_split_regex(norm, '\\n[ \\n]*\\n')) AS x, unnest(range(len(string_split_regex(norm, '\\n[ \\n]*\\n')))) AS unit_no FROM d),
u AS (SELECT doc_id, 'line' AS unit, unit_no, 1 AS n_paragraphs, trim(x) AS words FROM l
      UNION ALL SELECT doc_id, 'block', unit_no, 1, trim(regexp_replace(x, '[ \\n]+', ' ', 'g')) FROM k WHERE regexp_matches(x, '[a-z0-9] *\\n[ \\n]*[a-z0-9]')
      UNION ALL SELECT doc_id, 'run', i, n, words FROM (SELECT doc_id, i, n, array_to_string(p[i + 1 : i + n], ' ') AS words FROM (
        SELECT doc_id, p, i, unnest(range(2, least({RUN}, len(p) - i) + 1)) AS n FROM (SELECT doc_id, p, unnest(range(len(p) - 1)) AS i FROM (
          SELECT doc_id, list_filter(list_transform(string_split_regex(norm, '\\n[ \\n]*\\n'), lambda x: trim(regexp_replace(x, '[ \\n]+', ' ', 'g'))), lambda x: x <> '') AS p FROM d) AS q) AS o) AS c) AS e
        WHERE len(string_split(words, ' ')) BETWEEN {least} + 1 AND {most} + 1),
w AS (SELECT doc_id, unit, unit_no, n_paragraphs, string_split(words, ' ') AS w FROM u),
b AS (SELECT doc_id, unit, unit_no, n_paragraphs, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > {least}),
s AS (SELECT doc_id, unit, unit_no, n_paragraphs, len(b) AS n_bigrams, name, len(list_intersect(b, bigrams)) AS common, len(bigrams) AS size
      FROM b JOIN t ON 3 * len(b) >= 2 * len(bigrams) AND 2 * len(b) <= 3 * len(bigrams) WHERE len(b) BETWEEN {least} AND {most}),
r AS (SELECT *, round(2.0 * common / (n_bigrams + size), 6) AS dice FROM s WHERE 10 * common >= 4 * (n_bigrams + size))
SELECT doc_id, unit, unit_no::INT AS unit_no, n_paragraphs::INT AS n_paragraphs, n_bigrams::INT AS n_bigrams, name AS license_id, dice::DOUBLE AS dice FROM r
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, unit_no, n_paragraphs ORDER BY dice DESC, name) = 1
"""


SQL = _sql()
