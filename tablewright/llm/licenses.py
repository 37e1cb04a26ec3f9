"""Licence scans by diagonal voting, in DataFrame and SQL functions only.

All runs of three words of every text are joined by hash with the places of such runs in licence statements. Each hit votes for a diagonal
(its place in the text less its place in the statement); diagonals close to each other are one copy with words added or
left out. Each merged diagonal is verified by the statement's words that it lays in order over words of the text: those that its
hits cover. A copy counts if enough of them do, in a span of fitting length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import LAST_ID
from tablewright.llm.native import NO_LETTERS, grams, hashes, let, lowered, text_of, upto, words

#: Phrases that name a licence, and their labels. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Statements of licences, and their labels. The public texts, as licensors tell people to write them.
STATEMENTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike"),
    ("cc-by", "Licensed under CC BY 4"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4"),
]


@dataclass(frozen=True)
class LicenseScan:
    run: int = 3  # words of a run
    near: int = 3  # diagonals this close to the one before belong to one copy
    least_share: int = 80  # hundredths of a statement's runs that a copy must hold, or of its words, if it has enough of them
    enough: int = 10  # words; of a shorter statement a single word may be what tells it from another
    short: int = 16  # words; of statements up to this length the last word, which tells variants apart, must be there
    longest: int = 150  # hundredths of a statement's length that a copy's span may have


def statements(spark: SparkSession, texts: list[tuple[str, str]], scan: LicenseScan) -> DataFrame:
    """(statement, label, n_runs, n, place, run): the runs of words of every statement."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(texts)], "statement int, label string, text string")
    hashed = rows.select("statement", "label", hashes(words(lowered(F.col("text")), NO_LETTERS)).alias("w"))
    runs = hashed.select("statement", "label", F.size("w").alias("n"), grams(F.col("w"), list(range(scan.run))).alias("runs"))
    return runs.select("statement", "label", "n", F.size("runs").alias("n_runs"), F.posexplode("runs").alias("place", "run"))


def copies(hashed: DataFrame, known: DataFrame, scan: LicenseScan) -> DataFrame:
    """(doc, digest, label, share, first_word, last_word): the verified copies in texts given as doc, digest and w (hashed words)."""
    # An outer explode: of an inner one Spark asks beforehand whether it has rows, and would split the text again for every word.
    runs = hashed.select("doc", "digest", F.posexplode_outer(grams(F.col("w"), list(range(scan.run)))).alias("at", "run"))
    # The statements are a fixed list, so they go to every task. Hits are few; equal rows of a repeated document count once.
    hits = runs.join(F.broadcast(known), "run").select("doc", "digest", "statement", "label", "n", "n_runs", "place", "at").distinct()
    votes = hits.withColumn("diagonal", F.col("at") - F.col("place"))
    order = Window.partitionBy("doc", "digest", "statement").orderBy("diagonal")
    before = F.lag("diagonal").over(order)
    votes = votes.withColumn("opens", (before.isNull() | (F.col("diagonal") - before > scan.near)).cast("int"))
    votes = votes.withColumn("copy", F.sum("opens").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    found = votes.groupBy("doc", "digest", "statement", "label", "n", "n_runs", "copy").agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first_word"), (F.max("at") + scan.run - 1).alias("last_word")
    )
    # One changed word costs a run for each of its places in a run, but itself only where words are counted.
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + scan.run - 1)))))
    found = found.withColumns({"runs": F.size("places"), "covered": covered})
    found = found.withColumn("share", F.greatest(F.col("runs") / F.col("n_runs"), F.col("covered") / F.col("n")))
    by_runs = 100 * F.col("runs") >= scan.least_share * F.col("n_runs")
    by_words = (F.col("n") >= scan.enough) & (100 * F.col("covered") >= scan.least_share * F.col("n"))
    whole_end = (F.col("n") > scan.short) | (F.array_max("places") + scan.run == F.col("n"))
    fits = (by_runs | by_words) & whole_end & (100 * (F.col("last_word") - F.col("first_word") + 1) <= scan.longest * F.col("n"))
    return found.where(fits).select("doc", "digest", "label", "share", "first_word", "last_word")


def _places(w: Column, phrase: str) -> Column:
    parts = phrase.split()

    def fits(i: Column) -> Column:
        # The last word of a phrase is the rarest, so it is compared first.
        out = F.get(w, i + len(parts) - 1) == parts[-1]
        for k, part in list(enumerate(parts))[:-1]:
            out = out & (F.get(w, i + k) == part)
        return out

    return F.filter(upto(F.size(w) - len(parts)), fits)


def scan_licenses(docs: DataFrame, scan: LicenseScan = LicenseScan(), id_column: str = "doc_id", text_column: str = "text", texts: list[tuple[str, str]] = STATEMENTS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, copies.

    A NULL text has no words: counts of 0, no place, empty labels, score 0. copies lists the spans of the copies found.
    score is 1 where a phrase stands, else the largest share of a statement's runs or words that was found in a copy. Repeated rows
    give repeated results, a long text is scanned whole, an empty table gives no rows; other columns are not read.
    """
    text = lowered(text_of(f"`{text_column}`"))
    source = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("doc"), text.alias("text")).withColumn("digest", F.xxhash64("text"))
    source = source.withColumn("words", words(F.col("text"), NO_LETTERS))
    found = copies(source.select("doc", "digest", hashes(F.col("words")).alias("w")), statements(docs.sparkSession, texts, scan), scan)
    found = found.groupBy("doc", "digest").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share"), F.sort_array(F.collect_list(F.struct("first_word", "last_word", "label"))).alias("copies")
    )
    none = F.array().cast("array<struct<at:int,label:string>>")
    labels = F.transform("places", lambda x: x["label"])

    def named(phrase: str, label: str) -> Column:
        return F.transform(_places(F.col("words"), phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    per_phrase = [named(p, label) for p, label in PHRASES.items()]
    # Every phrase ends in this word; texts without it need no further look.
    places = F.when(F.contains("text", F.lit("license")), F.concat(*per_phrase)).otherwise(none)
    base = source.select("doc", "digest", F.size("words").cast("long").alias("n_words"), places.alias("places"))
    joined = base.join(found, ["doc", "digest"], "left")
    own = F.array_sort(F.array_distinct(labels)).cast("array<string>")
    empty = F.array().cast("array<string>")
    return joined.select(
        F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").cast("long").alias("first_word"),
        F.array_max("places.at").cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", empty))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        "copies",
    )
