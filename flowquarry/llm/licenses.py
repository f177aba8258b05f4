"""License scans over a positional index of rare tokens, in DataFrame functions only.

Templates (license texts, notices and phrases) are filed as postings (word, template, position) of their index words. A
pass over the texts keeps each document's index words with their positions, and with each the postings whose key phrase
stands word for word where the posting says. Counting index words over all documents gives each word's inverse document
frequency. A document's rarest words in each template are looked up in the postings; file position less template
position is where the template would start, and postings that agree on a start are intersected. A start is accepted
once its mandatory key phrase stands there and enough of the template's weight agrees on it.

Base phrases are templates whose key phrase is the whole phrase. Each is looked up by its rarest word, which every
one of its places has, so all places are found.

Defined cases: null and empty texts have no words and no labels; words are runs of ASCII letters and digits and
of characters beyond ASCII; overlapping places all count; words that tie in rarity are taken by code point, then place;
very long texts are scanned whole, one at a time, and keep a word and a position for each index word in them; rows with a
null id get labels by their own text; repeated rows give repeated results; an empty table gives an empty result; other
columns are not read, so their names are free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Fixed values of the base labels: phrase and label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices with labels of their own: label, text, mandatory key phrase.
NOTICES: list[tuple[str, str, str]] = [
    ("gpl-notice", "licensed under the gnu general public license version", "gnu general public license version"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("mit-notice", "released under the mit license", "under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "use copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("spdx", "spdx license identifier", "spdx license identifier"),
]

#: Whole texts of public licenses, as words: label, text, mandatory key phrase. Fixed values.
TEXTS: list[tuple[str, str, str]] = [
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
        "to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "the author disclaims all warranties with regard to this software",
    ),
    (
        "apache-text",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "unless required by applicable law or agreed to in writing",
    ),
    (
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program",
        "either version 3 of the license or at your option any later version",
    ),
]

#: Words that are too common to look anything up by.
COMMON = {"the", "of", "and", "or", "to", "is", "in", "by", "for", "with", "any", "a", "this", "at", "are", "be", "as", "it", "on", "under", "v", "0", "2", "use", "into"}
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD_SPLIT = f"[{BETWEEN}]+"
#: Index words of a template: all that are not common, or of a long one the longest so many.
MOST_WORDS = 12
#: Index words of a template that are looked up in each document, rarest first.
RAREST = 4
#: Share of the weight of a template's RAREST heaviest words that must agree on a start.
LEAST_SHARE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates() -> list[tuple[int, str, bool, list[str], list[str], int]]:
    """(number, label, is_base, words, key phrase, where the key phrase begins)."""
    out = []
    for n, (label, text, key, base) in enumerate([*[(v, k, k, True) for k, v in BASE.items()], *[(*x, False) for x in NOTICES + TEXTS]]):
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out.append((n, label, base, words, phrase, at))
    return out


def index_places(words: list[str]) -> list[int]:
    """The places of a template's index words."""
    kept = sorted({w for w in words} - COMMON, key=lambda w: (-len(w), w))[:MOST_WORDS]
    return [i for i, w in enumerate(words) if w in kept]


def postings() -> list[tuple[int, int, str, bool, str, int, list[str], int]]:
    """(number, template, label, is_base, word, place, key phrase, where it begins)."""
    found = [(t, label, base, words[p], p, phrase, at) for t, label, base, words, phrase, at in templates() for p in index_places(words)]
    return [(n, *x) for n, x in enumerate(found)]


def index_words() -> list[str]:
    return sorted({p[4] for p in postings()})


def any_of(words: list[str]) -> str:
    """A pattern for whole words, A-Z in either case; words that begin alike share that part, so that it is read once."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [c + pattern(below) for c, below in sorted(at.items()) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return f"(?:{body})?" if "" in at else body

    return f"(?i)(?<![^{BETWEEN}]){pattern(tree)}(?![^{BETWEEN}])"


def _mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, hits): per row its index words with positions, and the postings of each whose key phrase stands
    where the posting would have it."""
    listed = F.array(*map(F.lit, index_words()))
    seen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = seen.select("doc_id", F.filter(F.split("text", WORD_SPLIT), lambda w: w != "").alias("raw"), F.rlike(F.col("text"), F.lit(any_of(index_words()))).alias("any"))
    lowered = F.when(F.col("any"), F.transform("raw", lambda w: F.translate(w, UPPER, LOWER)))
    found = split.select("doc_id", F.size("raw").cast("long").alias("n_words"), lowered.alias("words"))
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(listed, w), i)), lambda i: i.isNotNull())
    by_word: dict[str, list] = {}
    for n, _, _, _, word, place, phrase, begin in postings():
        by_word.setdefault(word, []).append(F.struct(F.lit(n).alias("n"), F.lit(begin - place).alias("shift"), F.array(*map(F.lit, phrase)).alias("phrase")))
    table = F.create_map(*[x for word, own in by_word.items() for x in (F.lit(word), F.array(*own))])

    def stands(i: Column) -> Callable[[Column], Column]:
        return lambda p: F.when(i + p["shift"] >= 0, F.slice("words", i + p["shift"] + 1, F.size(p["phrase"])) == p["phrase"]).otherwise(False)

    hit = lambda i: F.struct(
        F.get("words", i).alias("word"), i.cast("long").alias("pos"), F.transform(F.filter(table[F.get("words", i)], stands(i)), lambda p: p["n"]).alias("fits")
    )
    return found.select("doc_id", "n_words", F.transform(at, hit).alias("hits"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rarest: int = RAREST, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = saved(_mentions(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "mentions")
    hits = rows.where(F.size("hits") > 0).select("row", F.inline("hits"))
    n = rows.agg(F.count("*").alias("n"))
    # Document frequencies of the index words, over all documents: at most one row a word.
    idf = hits.groupBy("word").agg(F.count_distinct("row").alias("df")).crossJoin(F.broadcast(n)).select("word", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    table = [p[:6] for p in postings()]
    filed = spark.createDataFrame(table, "posting int, template int, label string, base boolean, word string, place long").join(F.broadcast(idf), "word", "left")
    # A word in no document cannot be met; it still counts in its template's weight, as rare as a word can be.
    weighed = filed.crossJoin(F.broadcast(n)).withColumn("idf", F.coalesce("idf", F.log(F.col("n") + 1.0)) + 1e-9).drop("n")
    by_rarity = Window.partitionBy("template").orderBy(F.desc("idf"), "word", "place")
    weighed = weighed.withColumn("rank", F.row_number().over(by_rarity))
    # What a start must reach a share of: the weight of as many words as are looked up.
    weighed = weighed.withColumn("all_weight", F.sum(F.when(F.col("rank") <= rarest, F.col("idf"))).over(Window.partitionBy("template")))
    anchor = weighed.where(F.col("base") & (F.col("rank") == 1) | ~F.col("base"))

    met = hits.join(F.broadcast(anchor), "word")  # the postings of the templates above, a fixed number
    # In each document, a notice is looked up by the rarest of its words that the document has.
    own = Window.partitionBy("row", "template").orderBy("rank")
    met = met.withColumn("place_in_file", F.dense_rank().over(own)).where(F.col("base") | (F.col("place_in_file") <= rarest))
    starts = (
        met.withColumn("start", F.col("pos") - F.col("place"))
        .groupBy("row", "template", "label", "base", "start")
        .agg(F.max(F.array_contains("fits", F.col("posting"))).alias("stands"), F.sum("idf").alias("weight"), F.max("all_weight").alias("all_weight"))
        .where("stands")
    )
    shared = F.least(F.lit(1.0), F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("weight") / F.col("all_weight")))
    accepted = starts.withColumn("share", shared).where(F.col("base") | (F.col("share") >= least_share))
    base = F.col("base")
    labelled = accepted.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.round(F.max("share"), 6).alias("score"),
    )
    out = rows.drop("hits").join(labelled, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
