"""Operator 6: license scan by diagonal voting.

Every rolling word k-gram of every document joins the positions of the same k-gram in the templates.
A match votes for the diagonal: its place in the document less its place in the template. A word that is
inserted or dropped shifts the rest of a match to a neighbouring diagonal, so neighbours are merged into
bands, each of bounded width. A band is verified as a span of text: votes count by the distinct
positions of the template that they confirm, so a repeated phrase confirms its position once, and as
diagonals of a band lie close, the confirmed words stand in one stretch of about the template's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, read_table

K = 2
#: Share of a template's k-grams that a band must confirm.
SHARE = 0.75


def drift(words: int) -> int:
    """How far diagonals of a band may be apart, so how many words may be inserted or dropped in a template of so many words."""
    return 2 + words // 5


#: Phrases whose places are exact: all words stand consecutively.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Sentences of public licenses and common notices.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """(gram, tpos, tid, label, base, grams, drift): every k-gram of every phrase and template; a fixed, small table."""
    rows = []
    for tid, (text, label, base) in enumerate([(*p, True) for p in phrases] + [(*t, False) for t in templates]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a phrase needs {k} words: {text!r}")
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        rows += [(g, i, tid, label, base, len(grams), 0 if base else drift(len(words))) for i, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram string, tpos int, tid int, label string, base boolean, grams int, drift int").withColumn("h", F.xxhash64("gram"))


def license_scan(
    docs: DataFrame, keep: list[str], text: str = "text", phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
    k: int = K, share: float = SHARE,
) -> DataFrame:
    """`keep`, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row.

    A phrase stands where all its words do, on one diagonal. A template counts where a band confirms at
    least `share` of its k-grams. A null text counts as empty: no words, no places, empty labels, score 0.
    score is 1 if a phrase stands somewhere, else the largest share of a template's k-grams that one band
    confirms. spans holds each phrase's places and each template's best bands, one for bands that overlap:
    label, first word, last word, share. Every row is scanned for itself, so rows that repeat give
    repeated results; columns may have any name, and a kept one named like a result gets _doc at its end.
    """
    inner = [f"_k{i}" for i in range(len(keep))]
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner, strict=True)], words.alias("words"))
    # The row number is fixed by the scan's splits and used once, before the shuffle.
    rows = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", *inner, "words", F.size("words").cast("bigint").alias("n_words"))
    placed = rows.select("rid", *inner, "n_words", "words", F.posexplode_outer("words").alias("pos", "word"))
    more = [F.get("words", F.col("pos") + i) for i in range(1, k)]
    gram = F.when(more[-1].isNotNull(), F.concat_ws(" ", "word", *more))
    grams = placed.select("rid", *inner, "n_words", "pos", gram.alias("g")).withColumn("gh", F.xxhash64("g"))
    fixed = F.broadcast(template_grams(docs.sparkSession, phrases, templates, k))
    # An outer join, so that a document's first word keeps its row without a second pass.
    voted = grams.join(fixed, (F.col("gh") == F.col("h")) & (F.col("g") == F.col("gram")), "left").where("tid is not null or coalesce(pos, 0) = 0")
    of = ["tid", "label", "base", "grams"]
    votes = voted.select("rid", *inner, "n_words", "pos", *of, "tpos", "drift", (F.col("pos") - F.col("tpos")).alias("diagonal")).repartition("rid")
    own = ["rid", *inner, "n_words"]
    # From here on everything groups by the row, by which the votes are dealt. A vote counts in every band that holds its diagonal.
    bands = votes.select(*own, "pos", *of, "tpos", F.explode_outer(F.sequence(F.col("diagonal") - F.col("drift"), "diagonal")).alias("band"))
    bands = bands.groupBy(*own, *of, "band").agg(F.size(F.collect_set("tpos")).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    hit = F.col("n") / F.col("grams")
    bands = bands.withColumns({"hit": hit, "ok": F.coalesce(F.when(F.col("base"), F.col("n") == F.col("grams")).otherwise(hit >= share), F.lit(False))})
    # Bands that count and start one after another are one place; phrases' bands are one diagonal each.
    line = Window.partitionBy("rid", "tid", "ok").orderBy("band")
    place = F.when(F.col("base"), F.col("band")).otherwise(F.col("band") - F.row_number().over(line))
    best = Window.partitionBy("rid", "tid", "ok", "place").orderBy(F.desc("n"), F.col("hi") - F.col("lo"), "band")
    bands = bands.withColumn("place", place).withColumn("first", F.row_number().over(best) == 1)
    exact, found = F.col("ok") & F.col("base"), F.col("ok")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    span = F.struct("label", F.col("lo").alias("first_word"), (F.col("hi") + (k - 1)).alias("last_word"), F.col("hit").alias("share"))
    out = bands.groupBy(*own).agg(
        F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("band"))).cast("bigint").alias("first_word"),
        F.max(F.when(exact, F.col("band"))).cast("bigint").alias("last_word"),
        joined(exact).alias("base_labels"),
        joined(found).alias("labels"),
        F.coalesce(F.max(F.when(found | ~F.col("base"), F.col("hit"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(found & F.col("first"), span))).alias("spans"),
    )
    results = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    return out.select(*[F.col(i).alias(c) for c, i in zip(free_names(keep, results), inner, strict=True)], *results)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against all phrases and templates."""
    return license_scan(read_table(spark, sf_dir, "documents"), ["doc_id"]).drop("spans")
