"""License scans by diagonal voting.

The rolling k-gram hashes of a text's words are joined to the places where they stand in the templates. Every hit votes for the
diagonal (place in the text minus place in the template); votes are summed by diagonal, diagonals that lie within `NEAR` words
of each other (words put in or left out shift them) are merged. What is counted is verified: the words at each place that a hash
has voted for are compared with the template's, and the share of the template's k-grams that a merged span holds in words is
its score; spans under `LEAST` are dropped. Base phrases are looked up exactly beside that.

Words are runs of letters a-z, digits and characters from U+0080 on, after A-Z are lower-cased. The templates are a fixed table
of some hundred k-grams, so it is broadcast, whatever the size of the corpus.

Cases: null and empty texts have no words, no places and a score of 0; repeated rows keep a result each, as the votes are
grouped by a row key beside the id; ties go by template name; an empty table gives none; of the input only id and text are
read. Long texts: votes are rows, so that no group meets in one task; only words that a vote points at are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import ascii_lower, let

K, NEAR, LEAST = 3, 3, 0.6
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public notices by label: what a file or page says of its license.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("mit-line", "mit", "released under the mit license"),
    ("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-disclaimer", "mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-line", "apache", "licensed under the apache license version 2 0"),
    ("apache-notice", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-disclaimer", "apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-line", "gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-disclaimer", "gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("cc-by-line", "cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc-line", "cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-work", "cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd-grant", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-grant", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-notice", "mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(words: Column, k: int = K) -> Column:
    """The hashes of all windows of k words, in order."""
    return F.when(
        F.size(words) >= k,
        F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k)))),
    ).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark, k: int = K) -> DataFrame:
    """template, label, n_grams, said (words of a gram), gram, place: one row for each place of a template."""
    rows = spark.createDataFrame(list(TEMPLATES), "template string, label string, text string").coalesce(1)
    hashed = rows.select("template", "label", F.split("text", " ").alias("w")).select("template", "label", "w", grams(F.col("w"), k).alias("g"))
    placed = hashed.select("template", "label", "w", F.size("g").alias("n_grams"), F.posexplode("g").alias("place", "gram"))
    return placed.select("template", "label", "n_grams", F.slice("w", F.col("place") + 1, F.lit(k)).alias("said"), "place", "gram")


def phrase_places(words: Column) -> Column:
    """All (place, label) where a phrase's words stand in a row, by place."""
    joined = let(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), lambda j: _any([F.contains(j, F.lit(f" {p} ")) for p in PHRASES]))

    def here(i: Column) -> Column:
        found = [F.when(_all([F.get(words, i + n) == w for n, w in enumerate(p.split())]), F.struct(i.alias("place"), F.lit(label).alias("label"))) for p, label in PHRASES.items()]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    scan = F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), here))
    return F.when(joined, scan).otherwise(F.array().cast("array<struct<place:int,label:string>>"))


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def diagonal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified spans: doc_id, template, label, first_word, last_word (words from 0, last one included), score (share of the
    template's k-grams that the span holds). Documents of equal id and different text are kept apart by their text's hash."""
    spark = docs.sparkSession
    both = let(words_of(F.col(text)), lambda w: F.struct(w.alias("words"), grams(w).alias("grams")))
    gram_rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), both.alias("x")).select("doc_id", "row", "x.words", F.posexplode("x.grams").alias("at", "gram"))
    met = gram_rows.join(F.broadcast(template_grams(spark)), "gram").where(F.slice("words", F.col("at") + 1, F.lit(K)) == F.col("said"))
    votes = met.select("doc_id", "row", "template", "label", "n_grams", "at", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    key = ["doc_id", "row", "template", "label", "n_grams"]
    by_diagonal = votes.groupBy(*key, "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    ordered = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    opened = F.when(F.col("diagonal") - F.lag("diagonal").over(ordered) <= NEAR, 0).otherwise(1)
    bands = by_diagonal.withColumn("opened", opened).withColumn("band", F.sum("opened").over(ordered))
    merged = bands.groupBy(*key, "band").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), F.max("last").alias("last"))
    score = F.size("places") / F.col("n_grams")
    return merged.where(score >= LEAST).select("doc_id", "row", "template", "label", F.col("first").alias("first_word"), (F.col("last") + K - 1).alias("last_word"), score.alias("score"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, base (array of place, label), spans (array of template, label, first_word, last_word, score)."""
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("row"),
        let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), phrase_places(w).alias("base"))).alias("x"),
    ).select("doc_id", "row", "x.n_words", "x.base")
    spans = diagonal_spans(docs, doc_id, text).groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("template", "label", "first_word", "last_word", "score"))).alias("spans")
    )
    same = base["doc_id"].eqNullSafe(spans["doc_id"]) & (base["row"] == spans["row"])
    none = F.array().cast("array<struct<template:string,label:string,first_word:int,last_word:int,score:double>>")
    return base.join(spans, same, "left").select(base["doc_id"], "n_words", "base", F.coalesce("spans", none).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. score: the best span's, or 1 where a base
    phrase stands."""
    found = scan(docs)
    place = F.transform("base", lambda b: b["place"])
    label = F.transform("base", lambda b: b["label"])
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(place).cast("long").alias("first_word"),
        F.array_max(place).cast("long").alias("last_word"),
        listed(label).alias("base_labels"),
        listed(F.concat(label, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))).alias("score"),
    )
