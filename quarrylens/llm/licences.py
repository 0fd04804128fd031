"""Operator 9: license scans by diagonal voting.

All rolling word 3-grams of all texts are hashed and joined by Spark to the positions they have in the templates (2-grams too, those that
templates of few words have: of five words with one changed no 3-gram may be left). A hit votes for the
diagonal, its position in the text less that in the template; votes are counted by diagonal, neighbouring diagonals (up to GAP words
inserted or left out) are merged if their spans meet, and each span left is verified on the words themselves: the share of the template's
words that a longest common subsequence finds in it. How many votes a span must have follows from the coverage wanted: each word that is
missing takes at most N of them. The templates are a fixed table of short notices and standard license texts.

Defined results: words are runs of letters and digits, in lower case; null and empty texts have no hits. Equal templates give a hit each.
Rows of equal id and text count once. Null ids keep their hits. Of spans of a text that overlap, whatever their templates, the one with
the most words of its template stays (ties: the better covered, then the earlier place, then the later name), then the best of those that
overlap none that stays, and so on. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.textblock import blocks, col, eased, gram_hash, put_lists, raw, span_hash
from quarrylens.runtime import materialize, ship, small_side

N = 3
GAP = 4  # words by which neighbouring diagonals may differ
COVER = 0.8  # of a template's words
_OUT = np.ones(256, bool)
_OUT[48:58] = _OUT[65:91] = _OUT[97:123] = _OUT[128:] = False

TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": "licensed under the GNU General Public License, version 3",
    "gpl-2.0-notice": "licensed under the GNU General Public License, version 2",
    "lgpl-notice": "licensed under the GNU Lesser General Public License",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "all-rights-reserved": "All rights reserved.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "gpl-or-later-notice": "either version 2 of the License, or (at your option) any later version",
    "gpl-3.0-or-later-notice": "either version 3 of the License, or (at your option) any later version",
    "agpl-notice": "licensed under the GNU Affero General Public License",
    "agpl-header": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "lgpl-header": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-4.0-long-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, and starts, ends and texts of the words."""
    data, offs = raw(pc.utf8_lower(col))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_OUT[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return data, starts, ends, np.searchsorted(offs, starts, side="right") - 1


def width(words: int, cover: float) -> int:
    """Words of the n-grams that find a template of so many words: three, or fewer where a copy that is just covered may have none."""
    return next((n for n in range(N, 1, -1) if votes_needed(words, n, cover) >= 1), 1)


def votes_needed(words: int, n: int, cover: float) -> int:
    """The fewest n-grams that are left of a template when as many words are missing as its coverage allows."""
    return words - n + 1 - n * int(words * (1 - cover) + 1e-9)


def _hashes(short: np.ndarray):
    """Hashes of all 3-grams, and of those shorter ones that are in `short`, with their places."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                data, starts, ends, doc = words(b.column(2))
                h = span_hash(data, starts, ends)
                parts = [gram_hash(h, doc, N)]
                for n in range(1, N) if len(short) else ():
                    g, at = gram_hash(h, doc, n)
                    some = np.isin(g.view(np.int64), short)
                    parts.append((g[some], at[some]))
                g, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                o = np.argsort(at, kind="stable")
                g, at = g[o], at[o]
                first = np.searchsorted(doc, np.arange(b.num_rows))
                n = np.bincount(doc[at], minlength=b.num_rows)
                place = put_lists((at - first[doc[at]]).astype(np.int32), n, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), put_lists(g.view(np.int64), n, pa.int64()), place], ["d", "t", "grams", "places"])

    return run


def template_grams(templates: Mapping[str, str], cover: float = COVER) -> list[tuple[int, str, int, int, int]]:
    """(hash, template, position, n, votes needed) of the n-grams of the templates, each of its own width."""
    out = []
    for name in sorted(templates):
        data, starts, ends, doc = words(pa.array([templates[name]], pa.string()))
        n = width(len(starts), cover)
        h, at = gram_hash(span_hash(data, starts, ends), doc, n)
        need = max(1, votes_needed(len(starts), n, cover))
        out += [(int(x), name, int(i), n, need) for x, i in zip(h.view(np.int64), at.tolist(), strict=True)]
    return out


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, a word of `a` a bit."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & at.get(y, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def license_spans(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", cover: float = COVER) -> DataFrame:
    """(doc_id, license, first_word, last_word, votes, coverage): spans of words, from 0, the last included, that hold a template."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.where(col(text).isNotNull()).select(col(doc_id).alias("d"), F.xxhash64(col(text)).alias("t"), col(text).alias("text"))
    kind = dict(texts.dtypes)["d"]
    size = {k: len(words(pa.array([v]))[1]) for k, v in templates.items()}
    rolled = template_grams(templates, cover)
    known = spark.createDataFrame(rolled, "gram bigint, license string, tpos int, n int, need int")
    sizes = spark.createDataFrame(list(size.items()), "license string, words int")
    table = F.broadcast(known.join(F.broadcast(sizes), "license"))  # as large as the given templates
    short = np.unique(np.array([r[0] for r in rolled if r[3] < N], np.int64))
    grams = texts.mapInArrow(eased(_hashes(short)), f"d {kind}, t bigint, grams array<bigint>, places array<int>").select("d", "t", F.explode(F.arrays_zip("places", "grams")).alias("x")).select("d", "t", F.col("x.places").alias("pos"), F.col("x.grams").alias("gram"))
    hits = grams.join(table, "gram").groupBy("d", "t", "license", "words", "need", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    votes = hits.agg(F.count_distinct("tpos").alias("n"), F.min("pos").alias("a"), F.max(F.col("pos") + F.col("n") - 1).alias("z"))
    w = Window.partitionBy("d", "t", "license").orderBy("diagonal", "a")
    near = (F.col("diagonal") - F.lag("diagonal").over(w) <= GAP) & (F.col("a") <= F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1)) + GAP)
    runs = votes.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    spans = runs.groupBy("d", "t", "license", "words", "need", "run").agg(F.sum("n").alias("votes"), F.min("a").alias("a"), F.max("z").alias("z"), F.min("diagonal").alias("least"), F.max("diagonal").alias("most"))
    spans = spans.where("votes >= need")
    spans = spans.select("d", "t", "license", "votes", F.greatest(F.lit(0), F.least("a", "least")).alias("lo"), F.greatest("z", F.col("most") + F.col("words") - 1).alias("hi"))
    wanted = materialize(spans.groupBy("d", "t").agg(F.collect_list(F.struct("license", "votes", "lo", "hi")).alias("spans")))
    side = F.broadcast(wanted) if small_side(wanted) else wanted
    mine = texts.alias("x").join(side.alias("y"), F.col("x.d").eqNullSafe(F.col("y.d")) & (F.col("x.t") == F.col("y.t"))).select("x.d", "x.t", "x.text", "y.spans")
    own = {k: [int(x) for x in span_hash(*words(pa.array([v]))[:3])] for k, v in templates.items()}

    def verify(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                data, starts, ends, doc = words(b.column(2))
                h = span_hash(data, starts, ends)
                first = np.searchsorted(doc, np.arange(b.num_rows + 1))
                rows, names, a, z, votes, covers = [], [], [], [], [], []
                for i, spans in enumerate(b.column(3).to_pylist()):
                    found = []
                    for s in spans:
                        t = own[s["license"]]
                        lo, hi = first[i] + s["lo"], min(first[i] + s["hi"], first[i + 1] - 1)
                        body = h[lo : hi + 1].tolist()
                        inside = set(t)
                        kept = [k for k, x in enumerate(body) if x in inside]
                        both = common(t, [body[k] for k in kept])
                        if both >= cover * len(t) - 1e-9:
                            at = int(lo - first[i])
                            found.append((both, both / len(t), -(at + kept[0]), s["license"], at + kept[-1], s["votes"]))
                    taken: list[tuple[int, int]] = []
                    for both, share, start, name, end, n in sorted(found, reverse=True):
                        if all(end < x or y < -start for x, y in taken):
                            taken.append((-start, end))
                            rows.append(i)
                            names.append(name)
                            a.append(-start)
                            z.append(end)
                            votes.append(n)
                            covers.append(share)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(names, pa.string()), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(votes, pa.int64()), pa.array(covers, pa.float64())], ["doc_id", "license", "first_word", "last_word", "votes", "coverage"])

    return mine.dropDuplicates(["d", "t"]).mapInArrow(eased(verify), f"doc_id {kind}, license string, first_word int, last_word int, votes bigint, coverage double")
