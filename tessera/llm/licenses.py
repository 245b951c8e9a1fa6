"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut

#: Licence statements by identifier; several wordings each. A parameter of scan().
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
)
#: Full texts and file headers, compared with paragraphs and with whole texts.
FULL: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
)
#: Comment marks at a line's start and end.
MARK = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--)?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$"
#: A line of a header: a comment, or blank.
HEADER_LINE = r"^\s*(?:/\*|\*|//|#|--|;|%|<!--|$)"
#: A term: letters and digits, with dots and hyphens inside.
TERM = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"
#: Basenames of files whose licence holds for their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"


def _terms(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", text.lower())


class Weights:
    """TF-IDF over the templates: idf of a term is 1 + ln((1 + n) / (1 + templates with it)); other terms have the most."""

    def __init__(self, templates: tuple[tuple[str, str], ...], full: tuple[tuple[str, str], ...] = ()):
        n, counted = len(templates), [_terms(text) for _, text in templates]
        df = {t: sum(t in x for x in counted) for x in counted for t in x}
        self.idf = {t: 1 + math.log((1 + n) / (1 + d)) for t, d in df.items()}
        self.other = 1 + math.log(1 + n)
        # long templates don't change the weights of the short ones
        counted += [_terms(text) for _, text in full]
        self.idf |= {t: self.other for x in counted[n:] for t in x if t not in self.idf}
        self.rows = []  # (template, licence, term, weight at length 1)
        for i, ((name, _), terms) in enumerate(zip(templates + full, counted, strict=True)):
            w = {t: terms.count(t) * self.idf[t] for t in terms}
            length = math.sqrt(sum(x * x for x in w.values()))
            self.rows += [(i, name, t, x / length) for t, x in sorted(w.items())]

    def cues(self, least: float) -> set[str]:
        """Terms of which any text of cosine ``least`` to a template has one: without them too little weight is left.

        Long terms first, for short ones are common words elsewhere."""
        out: set[str] = set()
        for i in {r[0] for r in self.rows}:
            left = {t: w for j, _, t, w in self.rows if j == i}
            for t in sorted(left, key=lambda t: (t not in out, len(t) <= 4, -left[t], t)):
                if math.sqrt(sum(w * w for w in left.values())) < least:
                    break
                out.add(t)
                del left[t]
        return out


def _cued(text: Column, w: Weights, least: float) -> Column:
    """Has a text one of the terms without which it can't come to ``least``? True of a text if it is of a part of it."""
    by: dict[str, list[str]] = {}
    for x in sorted(w.cues(least)):
        by.setdefault(x[0], []).append(re.escape(x[1:]))
    # by first letter, so that a word is held against few of them
    cues = "|".join(f"{re.escape(a)}(?:{'|'.join(rest)})" for a, rest in by.items())
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{cues})(?![\p{{L}}\p{{N}}])")


def _cosines(spark: SparkSession, segments: DataFrame, w: Weights, least: float) -> DataFrame:
    """(key, segment, text) to (key, segment, words, licence, similarity): the best template of ``least`` or more.

    Segments are dealt once; their terms, norms and products are counted where they are and never shuffled."""
    near = segments.where(_cued(F.col("text"), w, least)).repartition("key", "segment").distinct()
    terms = near.select("key", "segment", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    tf = terms.groupBy("key", "segment", "term").agg(F.count("*").alias("tf"))
    idf = spark.createDataFrame(sorted(w.idf.items()), "term string, idf double")
    table = spark.createDataFrame(w.rows, "template int, licence string, term string, weight double")
    per_term = table.groupBy("term").agg(F.collect_list(F.struct("template", "licence", "weight")).alias("t"))
    # both tables hold the terms of the templates and nothing else, so their size is fixed
    weighted = tf.join(F.broadcast(idf.join(per_term, "term")), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(w.other)))
    norms = weighted.groupBy("key", "segment").agg(F.sum(F.col("w") * F.col("w")).alias("n2"), F.sum("tf").alias("words"), F.flatten(F.collect_list(F.transform("t", lambda x: F.struct(x["template"].alias("template"), x["licence"].alias("licence"), (x["weight"] * F.col("w")).alias("d"))))).alias("d"))
    dots = norms.select("key", "segment", "n2", "words", F.explode("d").alias("d")).groupBy("key", "segment", "n2", "words", "d.template", "d.licence").agg(F.sum("d.d").alias("dot"))
    cosine = F.round(F.col("dot") / F.sqrt("n2"), 6)
    best = dots.withColumn("c", cosine).where(F.col("c") >= least).groupBy("key", "segment", "words").agg(F.min(F.struct(-F.col("c"), "template", "licence")).alias("b"))
    return best.select("key", "segment", "words", "b.licence", (-F.col("b.col1")).alias("similarity"))


def _segments(text: Column) -> Column:
    """Lines, and sentences within them."""
    return F.split(text, r"\n|(?<=[.!?])\s+(?=\p{Lu})")


def _joined(texts: DataFrame) -> DataFrame:
    """(key, text) to (key, joined): paragraphs (neighbouring lines joined), their sentences, the leading comment and the whole text, without comment marks.

    What several of them need is a column, and made once."""
    plain = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    flat = lambda x: plain(F.regexp_replace(x, MARK, ""))
    bare = texts.select("key", F.split("text", "\n").alias("lines"), F.regexp_replace("text", MARK, "").alias("bare"))
    # lines are looked at up to the first that is no comment
    upto = F.aggregate("lines", F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct(F.when(s["on"] & x.rlike(HEADER_LINE), s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(s["on"], x.rlike(HEADER_LINE)).otherwise(False).alias("on")))["n"]
    cut_up = bare.select("key", F.transform(F.split("bare", r"\n{2,}"), flat).alias("paragraphs"), "lines", upto.alias("n"), plain(F.col("bare")).alias("whole"))
    header = flat(F.array_join(F.slice("lines", F.lit(1), F.col("n")), "\n"))
    return cut_up.select("key", F.array_distinct(F.concat("paragraphs", F.flatten(F.transform("paragraphs", _segments)), F.array(header, "whole"))).alias("joined"))


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.75, share: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Files (path, text) to path, licence, similarity, origin (own, inherited or none) and licence_path.

    Each line, sentence and paragraph, the leading comment and the whole text are compared with the templates; a file's own licence is that of its most
    similar statement (ties: first template, then first statement). A licence file is one with a usual basename, or
    whose statements hold ``share`` or more of its words; its licence holds for its directory, and a file without one
    of its own gets that of its nearest ancestor directory (ties in a directory: most similar, then least path).
    Rows that repeat a path are files of their own at the same path; a null path or text has no licence; path columns
    with empty parts are read as they are. An empty table gives no rows. Only path, text and the columns to ``carry`` along are read."""
    spark = files.sparkSession
    keyed = files.select("path", F.xxhash64("path", "text").alias("key"), "text", *[F.col(x).alias(f"_c_{x}") for x in carry])
    w = Weights(templates, FULL if templates is TEMPLATES else ())
    # what is taken from a text has no term that the text hasn't
    told = keyed.select("key", "text").where(_cued(F.col("text"), w, least))
    segments = told.select("key", F.posexplode(_segments(F.col("text"))).alias("segment", "text")).where("text IS NOT NULL")
    # lines come first; what is joined from them has places below zero and counts by its longest statement
    joined = _joined(told).select("key", F.posexplode("joined").alias("segment", "text")).withColumn("segment", -1 - F.col("segment"))
    found = cut(_cosines(spark, segments.union(joined), w, least), "statements")
    place = F.when(F.col("segment") < 0, (1 << 30) - F.col("segment")).otherwise(F.col("segment"))
    stated = F.greatest(F.sum(F.when(F.col("segment") >= 0, F.col("words"))), F.max("words"))
    own = found.groupBy("key").agg(F.min(F.struct(-F.col("similarity"), place.alias("place"), "licence")).alias("b"), stated.alias("stated"))
    own = cut(own.select("key", F.col("b.licence").alias("licence"), (-F.col("b.col1")).alias("similarity"), "stated"), "own")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    rows = keyed.select("path", "key", words.alias("words"), *[f"_c_{x}" for x in carry]).join(own, "key", "left")
    rows = cut(rows, "files")
    base = F.element_at(F.split("path", "/"), -1)
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    declares = rows.where("licence IS NOT NULL AND path IS NOT NULL").where(base.rlike(LICENCE_FILE) | (F.col("stated") >= share * F.col("words")))
    by = declares.withColumn("dir", parent).groupBy("dir").agg(F.min(F.struct(-F.col("similarity"), "path", "licence")).alias("b"))
    dirs = cut(by.select("dir", F.col("b.licence").alias("d_licence"), (-F.col("b.col1")).alias("d_similarity"), F.col("b.path").alias("d_path")), "dirs")
    # every ancestor directory of the paths without a licence of their own, nearest last
    orphans = rows.where("licence IS NULL AND path IS NOT NULL").select(parent.alias("home")).distinct()
    parts = F.split("home", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    climbs = orphans.select("home", F.explode(F.array_distinct(up)).alias("dir"))
    near = climbs.join(dirs, "dir").groupBy("home").agg(F.max(F.struct(F.length("dir"), "d_licence", "d_similarity", "d_path")).alias("n"))
    near = cut(near.select("home", "n.d_licence", "n.d_similarity", "n.d_path"), "inherited")
    out = rows.withColumn("home", F.when(F.col("licence").isNull(), parent)).join(near, "home", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("d_licence").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("licence", "d_licence").alias("licence"), F.coalesce("similarity", "d_similarity").alias("similarity"), origin.alias("origin"), F.coalesce(F.when(F.col("licence").isNotNull(), F.col("path")), F.col("d_path")).alias("licence_path"), *[F.col(f"_c_{x}").alias(x) for x in carry])


def document_licences(docs: DataFrame) -> DataFrame:
    """doc_id, source, path and the licence of each document, at the path source/lang/doc_id of its own."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    files = docs.select(F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text", "doc_id", "source")
    return scan(files, carry=("doc_id", "source"))
