"""License notices by diagonal voting, in DataFrame functions only.

All rolling word k-grams of the documents are joined by hash with the k-grams of the
templates. A match votes for the diagonal place-in-document minus place-in-template; the
k-gram itself is compared, not its hash alone. A diagonal that holds every k-gram of a phrase
is a place of that phrase. Neighbouring diagonals of a template are merged, so that a notice
with a word more or less stays one span, and a span counts if it covers enough of its template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from prismatica.llm.common import whole_text

K, GAP, COVERED = 3, 2, 0.8

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Standard sentences of public licenses and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of letters a-z in either case, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def _grams(of: Column) -> Column:
    return F.transform(of, lambda w, i: F.concat(w, F.lit(" "), F.get(of, i + 1), F.lit(" "), F.get(of, i + 2)))


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """(template, label, base, n_grams, at, gram, hash): a fixed table of a few hundred rows."""
    rows = []
    for n, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        w = text.split()
        rows += [(n, label, text in PHRASES, len(w) - k + 1, i, " ".join(w[i:i + k])) for i in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, at int, gram string").withColumn(
        "hash", F.xxhash64("gram"))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    n_base counts the places of base phrases, first_word and last_word are their least and
    largest word places (null without any), labels also hold those of covered notices, score
    is the largest covered share of a template. Null and empty texts have no words, no labels
    and score 0. Rows with equal key and text have equal results; null keys are allowed.
    """
    source = docs.select(F.col(f"`{key}`").alias("id"), whole_text(F.col(text)).alias("text"))
    digest = F.xxhash64("text").alias("digest")
    found = words(F.col("text"))
    # Two narrow passes over the texts cost less than carrying them through a join.
    sizes = source.select("id", digest, F.size(found).cast("long").alias("n_words"))
    grams = (source.select("id", digest, found.alias("words")).select("id", "digest", F.posexplode(_grams(F.col("words"))).alias("place", "seen"))
             .filter("seen is not null").withColumn("hash", F.xxhash64(F.lower("seen"))))
    votes = grams.join(F.broadcast(template_grams(docs.sparkSession)), "hash")  # fixed size: see PHRASES, NOTICES
    votes = votes.filter(F.translate("seen", UPPER, LOWER) == F.col("gram"))
    diagonals = votes.groupBy("id", "digest", "template", "label", "base", "n_grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"))
    order = Window.partitionBy("id", "digest", "template").orderBy("diagonal")  # at most a document's own matches
    starts = (F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int")
    spans = diagonals.withColumn("new", F.coalesce(starts, F.lit(0))).withColumn("span", F.sum("new").over(order)).groupBy(
        "id", "digest", "template", "label", "base", "n_grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"),
        F.count_if(F.size("ats") == F.col("n_grams")).alias("places"),
        F.min(F.when(F.size("ats") == F.col("n_grams"), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.size("ats") == F.col("n_grams"), F.col("diagonal"))).alias("last"))
    exact = F.col("base") & (F.col("places") > 0)
    share = F.col("covered") / F.col("n_grams")
    told = exact | (~F.col("base") & (share >= COVERED))
    results = spans.groupBy("id", "digest").agg(
        F.sum(F.when(exact, F.col("places")).otherwise(0)).alias("n_base"),
        F.min(F.when(exact, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(exact, F.col("last"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(exact, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(told, F.col("label")))), ",").alias("labels"), F.max(share).alias("score"))
    joined = sizes.alias("s").join(results.alias("r"), F.col("s.id").eqNullSafe(F.col("r.id")) & (F.col("s.digest") == F.col("r.digest")), "left")
    return joined.select(F.col("s.id").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
                         F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                         F.coalesce("score", F.lit(0.0)).alias("score"))
