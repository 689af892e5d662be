"""License scans by diagonal voting, in DataFrame operations alone.

All rolling word grams of a text (of two words for phrases, of four for templates) are hashed and joined with the
places of the same grams in phrases and templates; that side is small and fixed, so it is broadcast after a check of
its size. A match votes for the diagonal (place in the text less place in the template) on which an unbroken copy
would lie; votes are summed per document, template and diagonal before anything is shuffled. A diagonal with all grams
of a phrase is an exact occurrence.

For templates, every diagonal is taken together with its neighbours, no further away than a twentieth of the template's
length, so that words put in or left out do not break a copy. What counts is how many different places of the template
the neighbourhood covers: grams that a text repeats add nothing, and a run of diagonals does not grow into a span of
its own. A neighbourhood that covers enough of the template is a verified span; of those next to each other the best
stays, and a span gives way to one that overlaps it, covers as many words and a greater share of its template (a notice
of one license is much like that of its sister).

Cases: null and empty texts have no words and no labels; repeated rows get equal results; rows of a null doc_id are
scanned by their text; a phrase has at least two words, a template four; words in other scripts are words like any
other; no rows give no rows; other columns are not used.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a gram of a phrase and of a template.
PHRASE_GRAM, GRAM = 2, 4
#: Least distance of diagonals that are neighbours; twice it, four times and so on for templates of LENGTHS times that.
NEAR, LENGTHS = 3, 20
#: Least share of a template's grams in a span.
COVERED = 0.6
#: Grams of all templates together that are broadcast.
TEMPLATE_GRAMS = 100_000


class Template(NamedTuple):
    """A license text or phrase; whole: it counts only where all its words stand consecutively."""

    label: str
    text: str
    whole: bool = False


#: Phrases that count where they stand whole: fixed values.
PHRASES = [
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
]

#: Texts and notices of public licenses, and the sentences by which texts are put under one: fixed values.
TEMPLATES = [
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License."""),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Licensed under the MIT License"),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE."""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
        FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE."""),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met"""),
    Template("gpl", "This work is licensed under the GNU General Public License"),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along
        with this program. If not, see https://www.gnu.org/licenses/."""),
    Template("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
        (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public
        License along with this library."""),
    Template("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Affero General Public License for more details. You should have received a copy of the GNU Affero General Public
        License along with this program. If not, see https://www.gnu.org/licenses/."""),
    Template("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the
        authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to
        use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
        claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from
        any source distribution."""),
    Template("boost", "Distributed under the Boost Software License, Version 1.0"),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means."""),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC"),
    Template("cc-by-sa", "Licensed under CC BY-SA"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def words(text: str) -> Column:
    """Words of a text in lower case (A-Z only): ASCII letters and digits and all that is not ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BETWEEN, -1), "")


def _rolled(frame: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, short, long: the hashed grams that start at each word of an array column w, null beyond its end."""
    shifted = [F.slice("w", F.lit(i + 1), F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(GRAM)]
    every = frame.where(F.size("w") > 1).select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "g"))

    def gram(k):
        return F.when(F.col(f"g.w{k - 1}").isNotNull(), F.xxhash64(F.lit(k), *(F.col(f"g.w{i}") for i in range(k))))

    return every.select(*keys, "pos", gram(PHRASE_GRAM).alias("short"), gram(GRAM).alias("long"))


def template_places(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """gram, template, place, grams, near, whole, label: where each gram stands in each phrase or template."""
    rows = []
    for i, t in enumerate(templates):
        grams = len(t.text.split()) - (PHRASE_GRAM if t.whole else GRAM) + 1
        if grams < 1:
            raise ValueError(f"{t.label}: a phrase has {PHRASE_GRAM} words at least, a template {GRAM}")
        rows.append((i, t.label, t.whole, t.text))
    if sum(len(t.text) for t in templates) > 2 * TEMPLATE_GRAMS:  # no more grams than half the characters
        raise ValueError("scan the templates in parts")
    own = spark.createDataFrame(rows, "template int, label string, whole boolean, text string").withColumn("w", words("text"))
    own = own.withColumn("grams", F.size("w") - F.when(F.col("whole"), PHRASE_GRAM - 1).otherwise(GRAM - 1))
    near = F.coalesce(*(F.when(F.col("grams") >= NEAR * 2**j * LENGTHS, NEAR * 2**j) for j in reversed(range(1, 11))), F.lit(NEAR))
    placed = _rolled(own.withColumn("near", near.cast("long")), "template", "label", "whole", "grams", "near")
    placed = placed.withColumn("gram", F.when(F.col("whole"), F.col("short")).otherwise(F.col("long"))).where("gram IS NOT NULL")
    return placed.withColumnRenamed("pos", "place").drop("short", "long")


def license_spans(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """Verified spans: doc_id, h (hash of the text), label, whole, first (word), last (word), score."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), words("text").alias("w"))
    places = F.broadcast(template_places(docs.sparkSession, templates))  # TEMPLATE_GRAMS rows at most
    grams = _rolled(source, "doc_id", "h").select("doc_id", "h", "pos", F.explode(F.array("short", "long")).alias("gram"))
    votes = grams.join(places, "gram")
    key = ["doc_id", "h", "template", "label", "whole", "grams", "near"]
    diagonals = written(votes.groupBy(*key, (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places")), "diagonals")
    exact = diagonals.where(F.col("whole") & (F.size("places") == F.col("grams"))).select(
        "doc_id", "h", "label", "whole", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("grams") + PHRASE_GRAM - 2).alias("last"), F.lit(1.0).alias("score")
    )
    return exact.unionByName(_copies(diagonals.where("NOT whole")))


def _copies(diagonals: DataFrame) -> DataFrame:
    """Verified spans of templates from their diagonals."""
    # in these units neighbours lie within `unit` for every template: its near is NEAR times a power of 2
    unit = NEAR << 10
    scaled = diagonals.withColumn("at", (F.col("diagonal") * (F.lit(unit) / F.col("near")).cast("long")).cast("long"))
    of = Window.partitionBy("doc_id", "h", "template").orderBy("at")
    around = of.rangeBetween(-unit, unit)
    scaled = scaled.withColumns({"lo": F.col("diagonal") + F.array_min("places"), "hi": F.col("diagonal") + F.array_max("places") + GRAM - 1})
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("places").over(around))))
    seen = scaled.withColumns({"covered": covered, "first": F.min("lo").over(around), "last": F.max("hi").over(around)})
    sound = seen.withColumn("score", F.col("covered") / F.col("grams")).where(F.col("score") >= COVERED)
    begins = F.coalesce(F.col("at") - F.lag("at").over(of) > unit, F.lit(True)).cast("int")
    copies = sound.withColumn("begins", begins).withColumn("copy", F.sum("begins").over(of))
    best = copies.groupBy("doc_id", "h", "template", "label", "whole", "copy").agg(F.max(F.struct("covered", -F.col("diagonal"), "score", "first", "last")).alias("b"))
    # spans of a document are few: one for each copy
    spans = best.groupBy("doc_id", "h").agg(F.collect_list(F.struct("label", "whole", "b.covered", "b.score", "b.first", "b.last")).alias("spans"))

    def stays(x):
        def better(y):
            return (y["label"] != x["label"]) & (y["first"] <= x["last"]) & (x["first"] <= y["last"]) & (y["covered"] >= x["covered"]) & (y["score"] > x["score"])

        return ~F.exists("spans", better)

    kept = spans.select("doc_id", "h", F.explode(F.filter("spans", stays)).alias("s"))
    return kept.select("doc_id", "h", "s.label", "s.whole", "s.first", "s.last", "s.score")


def scan(docs: DataFrame, phrases: list[Template] | None = None, templates: list[Template] | None = None) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base results are the exact occurrences of phrases; labels adds those of verified spans of templates; score is
    the best share of a phrase or template found.
    """
    spans = license_spans(docs, [*(PHRASES if phrases is None else phrases), *(TEMPLATES if templates is None else templates)])
    base = F.col("whole")
    found = spans.groupBy("doc_id", "h").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.size(words("text")).cast("long").alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h"))
    joined = rows.join(found.alias("f"), same, "left")
    return joined.select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
