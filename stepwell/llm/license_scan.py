"""Licence scan by a positional index of rare words.

The licence templates below are indexed by word and position. Each template is reached by the
word of its mandatory key phrase with the highest inverse document frequency (counted over all
documents): without that word a document cannot hold the template, with it all licence words of
the document vote for the template at the relative position ``place in document - place in
template``. So no template that stands in a text is missed, however many others stand there. A
template is found where enough of its words stand at their places, and every word of its key phrase,
common ones too. One scan of the texts; what leaves it is one row per document with the places of
licence words. Words common in any prose count only beside rarer licence words.

Column expressions, joins and aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import Stored, column

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: (label, text, mandatory key phrase), in words: fixed values, the clauses and notices of public licences.
TEMPLATES = [
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache", "may not use this file except in compliance with the license", "except in compliance with the license"),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed under the license is distributed on an as is basis"),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work", "prepare derivative works of publicly display publicly perform sublicense"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "to endorse or promote products derived from this software"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation covered by this license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "for any purpose with or without fee"),
    ("isc", "is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "this permission notice appear in all copies"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("mit", "and associated documentation files the software to deal in the software without restriction", "to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "fitness for a particular purpose and noninfringement"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "copy modify publish use compile sell or distribute"),
]
#: Words too common in any prose to be looked up wherever they stand. They have a place in the index like all others,
#: but are looked up only near rarer licence words.
COMMON = frozenset(
    "a an and any are as at be but by each for from free either if in into is it its list may must no nor not of on "
    "or other such that the this to under used was which with without you your".split()
)
#: A common word counts where a rarer licence word is so near, as in every key phrase.
NEAR = 2

SEPARATORS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
KELVIN = "\u212a"

#: Share of a template's words that must stand at their places.
SHARE = 0.6


def template_words() -> list[tuple[int, str, str, int, bool]]:
    """(template, label, word, place, in the key phrase) of every word."""
    rows = []
    for number, (label, text, phrase) in enumerate(TEMPLATES):
        words, key = text.split(), phrase.split()
        start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        for place, word in enumerate(words):
            rows.append((number, label, word, place, start <= place < start + len(key)))
    return rows


def _single_spaced(body: Column) -> Column:
    """Words in lower case, one space between them."""
    # lower() differs from A-Z alone in no ASCII letter but the one made from the Kelvin sign
    lowered = F.when(
        F.contains(body, F.lit(KELVIN)),
        F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
    ).otherwise(F.lower(body))
    return F.btrim(F.regexp_replace(lowered, SEPARATORS, " "), F.lit(" "))


def _n_words(spaced: Column) -> Column:
    """Words of a text in which every word has a space on either side of its own."""
    return ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def _own_spaces(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences of every whole text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null or empty text: no words, no labels, score 0. One row per input row, repeated ones and those of a null id too;
    a long text is scanned like any other, and its licence words, however many, are shuffled, not held by one task.
    ``score``: 1 where a base phrase or a whole template stands, else the largest share of a found template's words.
    """
    store = Stored(docs.sparkSession)
    body = F.coalesce(column(text), F.lit(""))
    df = docs.select(column(doc_id).alias("doc_id"), _single_spaced(body).alias("_flat"))
    df = df.withColumn(
        "_own",
        F.when(F.col("_flat") == "", F.lit("")).otherwise(
            F.concat(F.lit(" "), F.replace(F.col("_flat"), F.lit(" "), F.lit("  ")), F.lit(" "))
        ),
    )
    own = F.col("_own")
    length = F.octet_length(own)
    found = {p: _own_spaces(p) for p in BASE}
    counts = {p: ((length - F.octet_length(F.replace(own, F.lit(s), F.lit("")))) / len(s)).cast("bigint") for p, s in found.items()}
    index = template_words()
    every_word = {word for _, _, word, _, _ in index}
    looked_up, common = sorted(every_word - COMMON), sorted(every_word & COMMON)
    words = F.split("_flat", " ")
    df = df.select(
        "doc_id",
        "_own",
        _n_words(own).alias("n_words"),
        *[c.alias(f"_n{i}") for i, c in enumerate(counts.values())],
        words.alias("_words"),
    )
    df = df.withColumn(
        "_places",
        F.filter(F.transform("_words", lambda w, i: F.when(w.isin(looked_up), i).otherwise(-1)), lambda i: i >= 0),
    )
    steps = [d for d in range(-NEAR, NEAR + 1) if d]
    beside = F.flatten(F.transform("_places", lambda p: F.array(*[p + d for d in steps])))
    df = df.withColumn(
        "_places",
        F.concat(
            "_places",
            F.filter(F.array_distinct(beside), lambda p: F.coalesce((p >= 0) & F.get("_words", p).isin(common), F.lit(False))),
        ),
    )
    first, last, labels = [], [], []
    for i, (phrase, spaced) in enumerate(found.items()):
        has = F.col(f"_n{i}") > 0
        before = F.substring_index(own, spaced, 1)
        after = F.substring_index(own, spaced, -1)
        first.append(F.when(has, _n_words(before)))
        last.append(F.when(has, F.col("n_words") - _n_words(after) - len(phrase.split())))
        labels.append(F.when(has, F.lit(BASE[phrase])))
    some = F.array(*labels)
    scanned = store.keep(
        df.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            "n_words",
            sum((F.col(f"_n{i}") for i in range(1, len(found))), F.col("_n0")).alias("n_base"),
            F.least(*first).alias("first_word"),
            F.greatest(*last).alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(some))).alias("_base"),
            F.transform("_places", lambda p: F.struct(F.get("_words", p).alias("w"), p.alias("p"))).alias("_posts"),
            F.array_intersect("_words", F.array(*map(F.lit, looked_up))).alias("_distinct"),
        )
    )
    own_labels = aligned(scanned, index)
    joined = scanned.drop("_posts", "_distinct").join(own_labels, "_row", "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def rarest(index: list[tuple[int, str, str, int, bool]], frequency: dict[str, int]) -> dict[int, str]:
    """Template -> the word of its key phrase in the fewest documents."""
    found: dict[int, tuple[int, str]] = {}
    for number, _, word, _, in_key in index:
        if in_key and word not in COMMON:
            own = (frequency.get(word, 0), word)
            found[number] = min(found.get(number, own), own)
    return {number: word for number, (_, word) in found.items()}


def aligned(scanned: DataFrame, index: list[tuple[int, str, str, int, bool]]) -> DataFrame:
    """Templates found per row: _row, _found (labels), _share (largest share of words in place)."""
    spark = scanned.sparkSession
    some = scanned.filter(F.size("_distinct") > 0)
    # one row per template word at most, whatever the corpus holds
    frequency = {r["w"]: r["count"] for r in some.select(F.explode("_distinct").alias("w")).groupBy("w").count().collect()}
    anchors = rarest(index, frequency)
    some = some.filter(F.arrays_overlap("_distinct", F.array(*map(F.lit, sorted(set(anchors.values()))))))
    posts = some.select("_row", "_distinct", F.explode("_posts").alias("x"))
    posts = posts.select("_row", "_distinct", F.col("x.w").alias("w"), F.col("x.p").alias("p"))
    templates = spark.createDataFrame(
        [(*entry, anchors[entry[0]]) for entry in index], "t int, label string, w string, q int, in_key boolean, anchor string"
    )
    sizes = {t: (sum(r[0] == t for r in index), sum(r[0] == t and r[4] for r in index)) for t, *_ in index}
    needed = spark.createDataFrame([(t, a, b) for t, (a, b) in sizes.items()], "t int, n_all int, n_key int")
    votes = (
        posts.join(F.broadcast(templates), "w")  # fixed size: the templates above
        .filter(F.array_contains("_distinct", F.col("anchor")))
        .groupBy("_row", "t", "label", (F.col("p") - F.col("q")).alias("at"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("in_key").alias("k"))
        .join(F.broadcast(needed), "t")
        .filter((F.col("k") == F.col("n_key")) & (F.col("n") >= SHARE * F.col("n_all")))
    )
    return votes.groupBy("_row").agg(
        F.collect_set("label").alias("_found"), F.max(F.col("n") / F.col("n_all")).alias("_share")
    )
