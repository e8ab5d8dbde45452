"""License scans by diagonal voting.

Every license template is a word sequence. All rolling word pairs of a document join the templates'
pairs on their hash (and on the words, which rules out collisions). A hit votes for the diagonal
"place in the document minus place in the template". Votes are counted by diagonal; neighbouring
diagonals of a template, as left by an inserted or missing word, merge into one span; a span is
verified by the share of the template's pairs that it holds, in place. Short phrases must be whole
and on one diagonal; notices of few pairs must be whole, so the names of licenses that stand inside
longer notices are templates too.

The templates are a fixed list in this module, so the table sent to each executor has a fixed size.
What is shuffled is one row a document and one a vote; texts stay where they are read.

Defined cases: null or empty text has 0 words and no label (empty strings, score 0, null places);
repeated rows each get their row; equal words at many places give as many diagonals; columns of the
input other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import ascii_lower, doc_key, empty_text

#: ASCII letters and digits, and everything beyond ASCII; over lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals so far apart still belong to one span.
SLACK = 3
#: Share of a notice's pairs that a span must hold; notices of few pairs must be whole.
MIN_SHARE, FEW_PAIRS = 0.6, 10

# Base phrases with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Notices of well-known licenses, as their authors ask to use them.
NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("under the terms of the GNU Lesser General Public License", "lgpl"),
    ("under the terms of the GNU Affero General Public License", "agpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License", "epl"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("All rights reserved", "reserved"),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Affero General Public License", "agpl"),
    ("Mozilla Public License", "mpl"),
    ("Eclipse Public License", "epl"),
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def templates(spark: SparkSession, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """template, label, phrase, n_pairs, and for each pair its place and words."""
    rows = []
    for i, (text, label, phrase) in enumerate([(t, x, True) for t, x in PHRASES] + [(t, x, False) for t, x in (NOTICES if notices is None else notices)]):
        words = words_of(text)
        rows += [(i, label, phrase, len(words) - 1, j, a, b) for j, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    schema = "template int, label string, phrase boolean, n_pairs int, t_place int, t_first string, t_second string"
    return spark.createDataFrame(rows, schema).withColumn("pair", F.xxhash64("t_first", "t_second"))


def votes(docs: DataFrame, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """k1, k2, template, diagonal and the template places that voted; one more row a document, with
    null template, bears its words and the number of equal rows."""
    words = F.regexp_extract_all(ascii_lower(empty_text()), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", *doc_key(), words.alias("words"))
    # Place 0 stands for the document itself; word i of the text is at place i + 1.
    each = rows.select("doc_id", "k1", "k2", "words", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("place", "first"))
    follow = F.get("words", F.col("place"))
    pairs = each.select(
        "doc_id", "k1", "k2", "place", "first", follow.alias("second"), F.size("words").cast("long").alias("n_words"),
        F.when(F.col("place") > 0, F.xxhash64("first", follow)).alias("pair"),
    )
    known = F.broadcast(templates(docs.sparkSession, notices))
    same = (F.col("a.pair") == F.col("t.pair")) & (F.col("a.first") == F.col("t.t_first")) & (F.col("a.second") == F.col("t.t_second"))
    hits = pairs.alias("a").join(known.alias("t"), same, "left").where((F.col("place") == 0) | F.col("template").isNotNull())
    return hits.groupBy("k1", "k2", "template", (F.col("place") - 1 - F.col("t_place")).alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"), F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("n_pairs").alias("n_pairs"),
        F.collect_set("t_place").alias("places"), F.max("n_words").alias("n_words"), F.sum(F.when(F.col("place") == 0, 1).otherwise(0)).alias("n_rows"),
    )


def spans(voted: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Neighbouring diagonals merged; adds share of the template and `verified`."""
    by = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by) > F.when(F.col("phrase"), 0).otherwise(SLACK)
    islands = voted.withColumn("new", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(by))
    merged = islands.groupBy("k1", "k2", "template", "island").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "label", "phrase", "n_pairs")],
        *[F.max(c).alias(c) for c in ("n_words", "n_rows")],
        F.min(F.col("diagonal") + F.array_min("places")).cast("long").alias("start"),
        (F.max(F.col("diagonal") + F.array_max("places")) + 2).cast("long").alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
    )
    share = F.col("held") / F.col("n_pairs")
    return merged.withColumn("share", share).withColumn("verified", share >= F.when(F.col("phrase") | (F.col("n_pairs") < FEW_PAIRS), 1.0).otherwise(min_share))


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, the phrases' count and places, labels and score."""
    found = spans(votes(docs, notices), min_share)
    good = F.col("verified")
    phrase = good & F.col("phrase")

    def names(which):
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return (
        found.groupBy("k1", "k2")
        .agg(
            F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_rows").alias("n_rows"),
            F.sum(F.when(phrase, 1).otherwise(0)).cast("long").alias("n_base"),
            F.min(F.when(phrase, F.col("start"))).alias("first_word"), F.max(F.when(phrase, F.col("start"))).alias("last_word"),
            names(phrase).alias("base_labels"), names(good).alias("labels"),
            F.coalesce(F.round(F.max(F.when(good, F.col("share"))), 6), F.lit(0.0)).alias("score"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
