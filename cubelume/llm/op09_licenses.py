"""License scan by diagonal voting, in DataFrame functions only.

Every rolling 3-gram of a document's words is hashed and joined to the positions of the same 3-gram in the templates. A hit
votes for the diagonal document position - template position of its document and template. Where all 3-grams of
a template vote for one diagonal its words stand there consecutively: that is a base place for the three phrases. For the other
templates neighbouring diagonals (words put in or left out) are merged, and a span is verified if enough of the template's
3-grams are in it and it isn't much longer than the template.

Words: lower() stands for the lower-casing of A-Z. Beyond ASCII it changes letters within words only, never a word's borders,
and no template has such letters (the Kelvin sign, which becomes k, occurs in no base phrase's letters).

Defined results: null and empty texts have 0 words and empty labels; equal rows get equal results; an empty table gives no
rows; further columns are ignored. The templates are broadcast: their number is fixed below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, table, written

K = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this near are one span; least share of a template's 3-grams; most length of a span against the template's.
NEAR, LEAST_SHARE, MOST_LENGTH = 3, 0.6, 1.5
#: Templates of fewer words must stand there as they are.
SHORT = 9
# fixed values: base phrases and labels
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
# fixed values: wording of public licences
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _templates() -> list[tuple[int, str, bool, list[str]]]:
    """number, label, base?, words."""
    both = [(label, text, True) for label, text in BASE] + [(label, text, False) for label, text in TEMPLATES]
    return [(i, label, base, text.split()) for i, (label, text, base) in enumerate(both)]


def _positions(spark: SparkSession) -> DataFrame:
    """Every 3-gram of every template; nth counts the places of one 3-gram from 1."""
    rows, seen = [], {}
    for i, label, base, w in _templates():
        for p in range(len(w) - K + 1):
            g = tuple(w[p : p + K])
            seen[g] = seen.get(g, 0) + 1
            rows.append((i, p, label, base, len(w), seen[g], *g))
    t = spark.createDataFrame(rows, "template int, at int, label string, base boolean, words int, nth int, t0 string, t1 string, t2 string")
    return t.withColumn("h", F.xxhash64("t0", "t1", "t2"))


def votes(docs: DataFrame) -> DataFrame:
    """One row of each document (head: true), with n_words, and one of every 3-gram that it shares with a template (template not null):
    doc_id, key, n_words, head, template, label, base, words, nth, at, pos. docs: doc_id, key, text."""
    words = docs.select("doc_id", "key", F.split(F.lower("text"), SEPARATORS).alias("w"))
    n, blank = F.size("w"), [F.when(F.element_at("w", i) == "", 1).otherwise(0) for i in (1, -1)]
    zipped = words.select("doc_id", "key", F.greatest(n - blank[0] - blank[1], F.lit(0)).cast("long").alias("n_words"), blank[0].alias("skipped"), F.arrays_zip(F.col("w").alias("w0"), F.slice("w", 2, n).alias("w1"), F.slice("w", 3, n).alias("w2")).alias("g"))
    grams = zipped.select("doc_id", "key", "n_words", "skipped", F.posexplode("g").alias("i", "g"))
    grams = grams.select("doc_id", "key", "n_words", (F.col("i") == 0).alias("head"), (F.col("i") - F.col("skipped")).alias("pos"), "g.w0", "g.w1", "g.w2").withColumn("h", F.xxhash64("w0", "w1", "w2"))
    t = F.broadcast(_positions(docs.sparkSession))
    same = (grams["h"] == t["h"]) & (grams["w0"] == t["t0"]) & (grams["w1"] == t["t1"]) & (grams["w2"] == t["t2"])
    return grams.join(t, same, "left").where("head OR template IS NOT NULL").select("doc_id", "key", "n_words", "head", "template", "label", "base", "words", "nth", "at", "pos")


def spans(hits: DataFrame) -> DataFrame:
    """doc_id, key, label, base, first, last (words), share: verified spans of the votes that are hits."""
    who = ["doc_id", "key", "template", "label", "base", "words"]
    diagonals = hits.groupBy(*who, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count_distinct("at").alias("votes"), F.min("pos").alias("first"), (F.max("pos") + K - 1).alias("last"))
    grams = F.col("words") - (K - 1)
    whole = diagonals.where((F.col("base") | (F.col("words") < SHORT)) & (F.col("votes") == grams)).select(*who, "first", "last", F.lit(1.0).alias("share"))
    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    island = F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = diagonals.where(~F.col("base") & (F.col("words") >= SHORT)).withColumn("island", island)
    merged = near.groupBy(*who, "island").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    merged = merged.withColumn("share", F.least(F.col("votes") / grams, F.lit(1.0))).where((F.col("share") >= LEAST_SHARE) & (F.col("last") - F.col("first") + 1 <= F.col("words") * MOST_LENGTH))
    return whole.unionByName(merged.select(*who, "first", "last", "share"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(labels), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.coalesce(col(docs, "text"), F.lit(""))
    rows = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    voted = written(votes(rows), "license-votes")
    found = spans(voted.where("template IS NOT NULL")).groupBy("doc_id", "key").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        _joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        _joined(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    # the head's row may be there once for each template that has its 3-gram
    counted = voted.where(F.col("head") & (F.col("template").isNull() | (F.col("nth") == 1))).select("doc_id", "key", "n_words")
    same = counted["doc_id"].eqNullSafe(found["doc_id"]) & (counted["key"] == found["key"])
    out = counted.join(found, same, "left").select(counted["doc_id"], "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score"))
    return out


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    rows = [f"({i}, {p}, '{label}', {base}, {len(w)}, '{' '.join(w[p : p + K])}')" for i, label, base, w in _templates() for p in range(len(w) - K + 1)]
    return ", ".join(rows)


SQL = {
    "op9_licenses": rf"""
WITH t(template, tpos, label, base, words, gram) AS (VALUES {_values()}),
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT id, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS gram FROM (SELECT id, w, unnest(range(0, greatest(len(w) - 2, 0))) AS pos FROM d)),
v AS (SELECT id, template, label, base, words, pos - tpos AS diagonal, count(DISTINCT tpos) AS votes, min(pos) AS first, max(pos) + 2 AS last
  FROM g JOIN t USING (gram) GROUP BY ALL),
n AS (SELECT *, sum(apart) OVER (PARTITION BY id, template ORDER BY diagonal) AS island FROM (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY id, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS apart
  FROM v WHERE NOT base AND words >= {SHORT})),
m AS (SELECT id, label, base, min(first) AS first, max(last) AS last, least(sum(votes)::DOUBLE / (words - 2), 1.0) AS share, words FROM n GROUP BY id, template, label, base, words, island),
s AS (SELECT id, label, base, first, 1.0::DOUBLE AS share FROM v WHERE (base OR words < {SHORT}) AND votes = words - 2
  UNION ALL SELECT id, label, base, first, share FROM m WHERE share >= {LEAST_SHARE} AND last - first + 1 <= words * {MOST_LENGTH}),
f AS (SELECT id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM s GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN f USING (id)
""",
}
QUERIES = {"op9_licenses": op9_licenses}
