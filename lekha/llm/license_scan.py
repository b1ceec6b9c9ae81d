"""License notices in documents, found by voting on diagonals.

Every rolling k-gram of words is hashed and joined with the positions of the
templates' k-grams; equal hashes are confirmed on the words themselves. A match
at document position p and template position t votes for diagonal p - t. A
notice quoted word for word fills one diagonal; an inserted or lost word moves
the rest to a neighbouring one, so neighbouring diagonals are merged, and a
merged span counts as a notice if it covers enough of its template without
being stretched, unless another template fits the same words better. Short phrases are templates too, but of them only complete
diagonals count, one for each place.

A mark after the last word of a text joins a row of its own, so one reading of
the texts also counts their words. All work after the join is keyed by the
text's digest: copies of a text cost one group, and nothing longer than a
template's positions is gathered.

Defined cases: null and empty texts have no words and no labels; texts of fewer
words than k have no match. Null or repeated ids and repeated rows give rows of
their own. Only ``text`` is read beside the columns to keep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
END = -1  # hash of the mark after the last word; it stands for no word, so no k-gram equals it
PHRASE, NOTICE, MARK = "phrase", "notice", "end"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that always count, with their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# The wording of common public license notices.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
            " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
            " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
            " Software is furnished to do so, subject to the following conditions"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
                 " License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
            " conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
            " provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
            " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
              " with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
                  " compile, sell, or distribute this software"),
]


def words(text: Column) -> Column:
    """A-Z in lower case, then runs of letters, digits and anything beyond ASCII."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _grams(words: Column) -> Column:
    """(pos, hash) of every k-gram; ``words`` is a column that holds the array."""
    places = F.when(F.size(words) >= K, F.sequence(F.lit(0), F.size(words) - K)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda p: F.struct(p.alias("pos"), F.xxhash64(*[F.get(words, p + k) for k in range(K)]).alias("hash")))


def templates(spark: SparkSession, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per k-gram of a template (number, kind, label, length in words, position, hash, words), and one for the end mark."""
    rows = [(i, PHRASE if i < len(phrases) else NOTICE, label, text) for i, (label, text) in enumerate([*phrases, *notices])]
    made = spark.createDataFrame(rows, "template int, kind string, label string, text string").withColumn("w", words(F.col("text")))
    grams = made.select("template", "kind", "label", F.size("w").alias("length"), "w", F.inline(_grams(F.col("w")))).select(
        "template", "kind", "label", "length", F.col("pos").alias("t"), "hash", F.slice("w", F.col("pos") + 1, K).alias("gram"))
    mark = spark.createDataFrame([(-1, MARK, None, 0, 0, END, [])], grams.schema)
    return grams.unionAll(mark)


def diagonals(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, template, kind, label, length, diagonal, hits): the sorted template positions that each diagonal of a text matches.

    The end mark's diagonal is the text's number of words.
    """
    read = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), words(F.col("text")).alias("w"))
    mark = F.array(F.struct(F.size("w").alias("pos"), F.lit(END).cast("long").alias("hash")))
    rolled = read.select("key", "w", F.inline(F.concat(_grams(F.col("w")), mark)))
    # The templates are fixed text: a few hundred rows whatever the input.
    met = rolled.join(F.broadcast(grams), "hash").where(F.slice("w", F.col("pos") + 1, K) == F.col("gram"))
    return (met.groupBy("key", "template", "kind", "label", "length", (F.col("pos") - F.col("t")).alias("diagonal"))
            .agg(F.sort_array(F.collect_set("t")).alias("hits")))


def spans(found: DataFrame, slack: int = 6, coverage: float = 0.8) -> DataFrame:
    """(key, kind, label, template, first, last, score): phrase places, notices from merged diagonals, end marks; ``last`` is exclusive.

    Diagonals of a notice merge if they lie at most ``slack`` apart (a quarter
    of the template at most, so two copies in a row stay two). ``score`` is the
    number of template words inside confirmed k-grams over the longer of
    template and span: 1 for a phrase, ``coverage`` or more for a notice. Of
    notices that overlap in the text, the best count: one license's wording
    often is another's with a word more.
    """
    first = F.col("diagonal") + F.get("hits", F.lit(0))
    last = F.col("diagonal") + F.get("hits", F.size("hits") - 1) + K
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    near = (F.col("kind") == NOTICE) & (
        F.col("diagonal") - F.lag("diagonal").over(order) <= F.least(F.lit(slack), F.floor(F.col("length") / 4)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("hits")), lambda t: F.sequence(t, t + K - 1)))))
    least = F.when(F.col("kind") == PHRASE, 1.0).when(F.col("kind") == NOTICE, coverage).otherwise(0.0)
    merged = (found.withColumns({"first": first, "last": last, "new": F.when(near, 0).otherwise(1)})
              .withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("key", "kind", "label", "template", "length", "span")
              .agg(F.min("first").alias("first"), F.max("last").alias("last"), covered.alias("covered"))
              .withColumn("score", F.col("covered") / F.greatest("length", F.col("last") - F.col("first")))
              .where(F.col("score") >= least))
    order = Window.partitionBy("key", "kind").orderBy("first", "last", "template")
    past = (F.col("kind") == NOTICE) & (F.col("first") < F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return (merged.withColumn("new", F.when(past, 0).otherwise(1))
            .withColumn("place", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("best", F.max("score").over(Window.partitionBy("key", "kind", "place"))).where("score = best")
            .select("key", "kind", "label", "template", "first", "last", "score"))


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",), phrases: Sequence[tuple[str, str]] = PHRASES,
         notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """The kept columns, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per document.

    ``score`` is the largest share of a template that a span of the document
    covers: 1 with a phrase, 0 without any span.
    """
    found = spans(diagonals(docs, templates(docs.sparkSession, phrases, notices)))
    base, mark = F.col("kind") == PHRASE, F.col("kind") == MARK

    def joined(labels: Column) -> Column:
        return F.concat_ws(",", F.sort_array(labels))

    by_text = found.groupBy("key").agg(
        F.max(F.when(mark, F.col("first"))).cast("long").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"),
        F.coalesce(F.max(F.when(~mark, F.col("score"))), F.lit(0.0)).alias("score"))
    rows = docs.select(F.struct(*keep).alias("kept"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    return rows.join(by_text, "key").select("kept.*", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
