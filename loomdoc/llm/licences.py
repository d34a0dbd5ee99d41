"""License scans by Dice coefficient over word bigrams.

Texts and templates are normalised: A-Z in lower case, runs of anything but
letters a-z and digits one space, so line breaks and comment marks don't count.
The sets of 2-word shingles of two stretches, A and B, score
2|A and B| / (|A| + |B|). A template of b bigrams can reach `least` only on a
stretch that holds at least b * least / (2 - least) of its bigrams, so one of any
set of its bigrams that leaves out fewer than that: its keys. Wherever a text
holds a key, the stretch of the template's length is compared in which the key
stands where the template has it, cut at the text's ends; so a licence is found
anywhere in a text, whole or with some words changed. Size bounds prune first: a
stretch of a bigrams can reach `least` only with
b * least / (2 - least) <= a <= b * (2 - least) / least. Texts without any of the
keys' rarer words stop before their bigrams are built.

Of a family's licences (the two BSD texts, the GNU headers) those with the best
score in a text count, equal ones all. A licence's overlapping stretches are one
place. Null, empty and wordless texts, and texts of one word, have no bigrams and
no hits; repeated rows get equal hits; other columns are ignored; an empty table
gives no rows, no templates no hits. Whole texts are read, in one projection
without a shuffle; work grows with a text's words and with its keys' places.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.functions.text import let
from loomdoc.llm.common import lower_ascii

#: Least Dice coefficient.
LEAST = 0.8

_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU_END = "as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {l}General Public License for more details."
_GNU = "This program is free software{c} you can redistribute it and/or modify it under the terms of the GNU {l}General Public License " + _GNU_END


def _gnu(v: str, l: str = "", c: str = ":") -> str:  # noqa: E741
    return _GNU.format(v=v, l=l, c=c)


# Licences, headers and customary notices by (licence, family, text).
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("agpl-3.0", "gnu", _gnu("3", "Affero ")),
    ("all-rights-reserved", "all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("apache-2.0", "apache", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.'),
    ("bsd-2-clause", "bsd", f"{_BSD_START} {_BSD_END}"),
    ("bsd-3-clause", "bsd-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd-3-clause", "bsd", f"{_BSD_START} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("cc-by-4.0", "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "cc-notice", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "cc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "cc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "cc-notice", "Licensed under CC BY-SA 4.0."),
    ("gpl-2.0", "gnu-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "gnu", _gnu("2", c=";")),
    ("gpl-3.0", "gnu-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "gnu", _gnu("3")),
    ("gpl-3.0", "gnu-body", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("isc", "isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("lgpl-3.0", "gnu", _gnu("3", "Lesser ")),
    ("mit", "mit", "Released under the MIT License."),
    ("mit", "mit", "Licensed under the MIT License."),
    ("mit", "mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("mit", "mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("mpl-2.0", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl-2.0", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)

# Words that are no sign of a licence.
COMMON = frozenset("a all an and any are as at be but by can for from in is it its kind may means no not of on one or out other provided set so such that the this to under use was way what with without work works you your version form general public free following form file".split())


def normal_words(text: str) -> list[str]:
    """The words of a template as the scan normalises them."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def rare_word(gram: str) -> str:
    """The word of a bigram that the first look is for: the longest that is not common, else the longest."""
    return max(gram.split(), key=lambda w: (w not in COMMON, len(w), w))


def keys(grams: list[str], least: float) -> list[str]:
    """The rarest-looking bigrams of a template, so many that a stretch without any of them can't reach `least`."""
    needed = max(1, math.ceil(len(grams) * least / (2 - least) - 1e-9))
    return sorted(grams, key=lambda g: (rare_word(g) in COMMON, -len(rare_word(g)), g))[: len(grams) - needed + 1]


def compiled(templates: tuple[tuple[str, str, str], ...], least: float) -> list[tuple[str, str, int, list[str], list[tuple[str, int]]]]:
    """name, family, words, bigrams and (key, place) of every template with a bigram."""
    out = []
    for name, family, text in templates:
        words = normal_words(text)
        if grams := bigrams(words):
            every = [f"{a} {b}" for a, b in zip(words, words[1:])]
            out.append((name, family, len(words), grams, [(k, every.index(k)) for k in keys(grams, least)]))
    return out


def scan(docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hits (license, first word, words, dice; by licence and place), n_license_units (places of licences) and licenses."""
    table = compiled(templates, least)
    hit = "struct<family:string,license:string,first:int,words:int,dice:double>"
    clean = F.trim(F.regexp_replace(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+", " "))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.split(clean, " ").alias("w"))
    if not table:
        texts = texts.select("doc_id", F.array().cast(f"array<{hit}>").alias("hits"))
    else:
        low = lambda b: b * least / (2 - least)
        high = lambda b: b * (2 - least) / least
        rare = sorted({rare_word(k) for *_, ks in table for k, _ in ks})
        looked_for = sorted({k for *_, ks in table for k, _ in ks})
        constant = lambda rows, schema: F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")  # noqa: E731  folded once
        places = constant([{"key": k, "t": t, "at": at} for t, (*_, ks) in enumerate(table) for k, at in ks], "key:string,t:int,at:int")
        known = constant([{"name": name, "family": family, "n": n, "grams": grams, "low": low(len(grams)), "high": high(len(grams))} for name, family, n, grams, _ in table], "name:string,family:string,n:int,grams:array<string>,low:double,high:double")
        gram = lambda w, i: F.concat(w[i], F.lit(" "), w[i + 1])

        def stretches(w):
            found = F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda i: gram(w, i).isin(looked_for))
            each = F.transform(found, lambda i: let(gram(w, i), lambda g: F.transform(F.filter(places, lambda p: p["key"] == g), lambda p: F.struct(p["t"].alias("t"), (i - p["at"]).alias("first")))))
            return F.array_distinct(F.flatten(each))

        def judged(w, s):
            def of(t):
                first, end = F.greatest(s["first"], F.lit(0)), F.least(s["first"] + t["n"], F.size(w))
                own = F.array_distinct(F.transform(F.sequence(first, end - 2), lambda i: gram(w, i)))
                dice = lambda g: F.when((F.size(g) >= t["low"]) & (F.size(g) <= t["high"]), 2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + F.size(t["grams"])))
                return F.when(end - first - 1 >= t["low"], F.struct(t["family"].alias("family"), t["name"].alias("license"), first.alias("first"), (end - first).alias("words"), let(own, dice).alias("dice")))

            return let(F.element_at(known, s["t"] + 1), of)

        # two steps, so that a text's words stand in a column for the lambdas
        worth = texts.select("doc_id", F.when(F.arrays_overlap("w", F.array(*map(F.lit, rare))) & (F.size("w") > 1), F.col("w")).alias("w"))
        hits = F.filter(F.transform(stretches(F.col("w")), lambda s: judged(F.col("w"), s)), lambda h: h["dice"] >= least)
        texts = worth.select("doc_id", F.coalesce(F.when(F.col("w").isNotNull(), hits), F.array().cast(f"array<{hit}>")).alias("hits"))
    best = F.filter("hits", lambda h: ~F.exists("hits", lambda o: (o["family"] == h["family"]) & (o["dice"] > h["dice"])))
    by_place = F.array_sort(F.transform(best, lambda h: F.struct(h["license"].alias("license"), h["first"].alias("first"), h["words"].alias("words"), h["dice"].alias("dice"))))
    zero = F.struct(F.lit("").alias("license"), F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def place(a, h):
        same = (a["license"] == h["license"]) & (h["first"] < a["end"])
        end = h["first"] + h["words"]
        return F.struct(h["license"].alias("license"), F.when(same, F.greatest(a["end"], end)).otherwise(end).alias("end"), (a["n"] + F.when(same, 0).otherwise(1)).alias("n"))

    named = texts.select("doc_id", by_place.alias("hits"))
    return named.select("doc_id", "hits", F.aggregate("hits", zero, place, lambda a: a["n"]).alias("n_license_units"), F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"))


def oracle(templates: tuple[tuple[str, str, str], ...] = TEMPLATES, least: float = LEAST) -> str:
    """doc_id, n_license_units and licenses in DuckDB."""
    table = compiled(templates, least)
    rows = ", ".join(f"({t}, '{name}', '{family}', {n}, {len(grams)})" for t, (name, family, n, grams, _) in enumerate(table))
    grams = ", ".join(f"({t}, '{g}')" for t, (*_, grams, _) in enumerate(table) for g in grams)
    places = ", ".join(f"({t}, '{k}', {at})" for t, (*_, ks) in enumerate(table) for k, at in ks)
    return f"""
WITH t(t, name, family, n, b) AS (VALUES {rows}), tg(t, g) AS (VALUES {grams}), tk(t, g, pos) AS (VALUES {places}),
c AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS size, unnest(range(0, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM c WHERE len(w) > 1),
s AS (SELECT DISTINCT doc_id, size, tk.t, i - pos AS s FROM g JOIN tk ON g.g = tk.g),
x AS (SELECT doc_id, t, s, greatest(s, 0) AS first, least(s + n, size) AS stop, name, family, b FROM s JOIN t USING (t)),
m AS (SELECT x.doc_id, x.t, x.first, x.stop, name, family, b, count(DISTINCT g.g) AS a, count(DISTINCT tg.g) AS shared FROM x JOIN g ON g.doc_id = x.doc_id AND g.i BETWEEN x.first AND x.stop - 2 LEFT JOIN tg ON tg.t = x.t AND tg.g = g.g GROUP BY ALL),
d AS (SELECT *, 2.0::DOUBLE * shared / (a + b) AS dice FROM m),
f AS (SELECT *, max(dice) OVER (PARTITION BY doc_id, family) AS best FROM d WHERE dice >= {least}),
h AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id, name ORDER BY first, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE dice = best),
r AS (SELECT doc_id, count(*) FILTER (before = 0 OR first >= before) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM h GROUP BY doc_id)
SELECT c.doc_id, coalesce(r.n, 0)::BIGINT AS n_license_units, coalesce(r.names, '') AS licenses FROM c LEFT JOIN r USING (doc_id)"""
