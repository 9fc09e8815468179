"""License scans by diagonal voting of word k-grams against templates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3

#: The phrases of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "No rights reserved. Dedicated to the public domain under CC0 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() also turns U+0130 and U+212A into ASCII; texts with one of them go by translate().

    Other characters may change case too; no phrase or template holds any, and words end alike.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.contains("İ") | text.contains("K"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """_hash, _t, _j and the gram's words: every rolling K-gram of each template. Bounded by the templates."""
    rows = [(t, j, *w[j : j + K]) for t, (_, text) in enumerate(templates) if len(w := template_words(text)) >= K for j in range(len(w) - K + 1)]
    df = spark.createDataFrame(rows, "_t int, _j int, _x string, _y string, _z string")
    return df.withColumn("_hash", F.xxhash64("_x", "_y", "_z"))


def positions(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """_id, _digest, _i and the words _a, _b, _c from position _i (null past the end): one row per word."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_digest"), split_words(F.col(text)).alias("_w"))
    three = F.arrays_zip(F.col("_w").alias("_a"), F.expr("slice(_w, 2, greatest(size(_w) - 1, 0))").alias("_b"), F.expr("slice(_w, 3, greatest(size(_w) - 2, 0))").alias("_c"))
    rows = rows.filter(F.size("_w") >= 2).select("_id", "_digest", F.posexplode(three).alias("_i", "_g"))
    return rows.select("_id", "_digest", "_i", F.col("_g._a").alias("_a"), F.col("_g._b").alias("_b"), F.col("_g._c").alias("_c"))


def base_label() -> Column:
    """The phrase's label where one starts at the row's position, else null."""
    out = F.lit(None).cast("string")
    for phrase, label in PHRASES.items():
        parts = zip(("_a", "_b", "_c"), phrase.split(" "), strict=False)
        out = F.when(reduce(Column.__and__, [F.col(c) == w for c, w in parts]), label).otherwise(out)
    return out


def license_hits(docs: DataFrame, text: str, doc_id: str, templates: list[tuple[str, str]]) -> DataFrame:
    """_id, _digest, _i, _base, _t, _j: base phrases and K-grams shared with templates, nothing else.

    One pass over all positions; the template grams, of a size fixed by the code, are broadcast.
    Equal hashes are followed by equal words.
    """
    grams = template_grams(docs.sparkSession, templates)
    rows = positions(docs, text, doc_id).withColumn("_hash", F.xxhash64("_a", "_b", "_c")).withColumn("_base", base_label())
    joined = rows.join(F.broadcast(grams), "_hash", "left")
    same = (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y")) & (F.col("_c") == F.col("_z"))
    joined = joined.filter(F.col("_base").isNotNull() | same).withColumn("_same", F.coalesce(same, F.lit(False)))
    hits = joined.select("_id", "_digest", "_i", "_base", F.when(F.col("_same"), F.col("_t")).alias("_t"), F.when(F.col("_same"), F.col("_j")).alias("_j"))
    return hits.dropDuplicates()


def spans(hits: DataFrame, templates: list[tuple[str, str]], gap: int = 3, cover: float = 0.8) -> DataFrame:
    """_id, _digest, _label, _start, _end, _cover, _len: verified template spans.

    Grams vote for diagonals (text position minus template position). Along a text and template,
    votes whose diagonals differ by at most gap and whose positions lie within a template's length are
    neighbours and merge (words put in or left out). A merged run is verified by the share of the
    template's words that its grams cover word for word.
    """
    spark = hits.sparkSession
    known = F.broadcast(spark.createDataFrame([(t, label, len(template_words(text))) for t, (label, text) in enumerate(templates)], "_t int, _label string, _len int"))
    rows = hits.filter(F.col("_t").isNotNull()).join(known, "_t").withColumn("_d", F.col("_i") - F.col("_j"))
    diagonals = rows.groupBy("_id", "_digest", "_t", "_label", "_len", "_d").agg(F.collect_set("_j").alias("_js"), F.min("_i").alias("_from"), F.max("_i").alias("_to"))
    # A long repeat of a template lies on ever new diagonals; along one diagonal there are at most _len grams.
    w = Window.partitionBy("_id", "_digest", "_t").orderBy("_d", "_from")
    new = F.coalesce((F.col("_d") - F.lag("_d").over(w) > gap) | (F.col("_from") - F.lag("_from").over(w) > F.col("_len") + gap), F.lit(True))
    runs = diagonals.withColumn("_run", F.sum(new.cast("int")).over(w))
    merged = runs.groupBy("_id", "_digest", "_t", "_label", "_len", "_run").agg(F.flatten(F.collect_list("_js")).alias("_js"), F.min("_from").alias("_start"), (F.max("_to") + K).alias("_end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_js", lambda j: F.sequence(j, j + K - 1)))))
    merged = merged.withColumn("_cover", F.round(covered / F.col("_len"), 6))
    return merged.filter(F.col("_cover") >= cover).select("_id", "_digest", "_label", "_start", "_end", "_cover", "_len")


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: list[tuple[str, str]] | None = None, gap: int = 3, cover: float = 0.8) -> DataFrame:
    """One row per document: its id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    labels: the base labels and those of verified spans. A span inside one of a template of more words counts
    for nothing: its words belong to the longer notice. score: the best span's covered share; 1
    where a base phrase stands. spans: array of (label, start, end, cover), words counted from 0.
    Long texts are scanned whole.
    Null and empty texts: no words, empty labels, score 0. Null ids are an id of their own. Rows that
    repeat id and text get equal results. Empty tables give empty tables; other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    hits = written(license_hits(docs, text, doc_id, templates), "license-hits")
    base = hits.filter(F.col("_base").isNotNull()).groupBy("_id", "_digest").agg(F.countDistinct("_i").alias("n_base"), F.min("_i").alias("first_word"), F.max("_i").alias("last_word"), F.collect_set("_base").alias("_bases"))
    one = F.struct(F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_label").alias("label"), F.col("_cover").alias("cover"), F.col("_len").alias("len"))
    found = spans(hits, templates, gap, cover).groupBy("_id", "_digest").agg(F.sort_array(F.collect_list(one)).alias("_all"))
    found = found.withColumn("_all", F.expr("filter(_all, s -> not exists(_all, t -> t.len > s.len and t.start <= s.start and t.end >= s.end))"))
    found = found.select("_id", "_digest", F.array_distinct("_all.label").alias("_labels"), F.array_max("_all.cover").alias("_score"), F.transform("_all", lambda x: F.struct(x["start"], x["end"], x["label"], x["cover"])).alias("spans"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_digest"), F.size(split_words(F.col(text))).cast("long").alias("n_words"))
    for side in (base, found):
        side = side.withColumnsRenamed({"_id": "_id2", "_digest": "_digest2"})
        rows = rows.join(side, (F.col("_digest") == F.col("_digest2")) & F.col("_id").eqNullSafe(F.col("_id2")), "left").drop("_id2", "_digest2")
    none = F.array().cast("array<string>")
    bases, labels = F.coalesce("_bases", none), F.coalesce("_labels", none)
    return rows.select(
        F.col("_id").alias(doc_id), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.array_join(F.array_sort(bases), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(bases, labels)), ",").alias("labels"),
        F.when(F.size(bases) > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"), "spans",
    )


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's row of scan_licenses(); nulls, empty and long texts, ties, repeated rows and empty tables as said there."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    """The same in DuckDB SQL, for documents with distinct ids."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = [(t, label, template_words(text)) for t, (label, text) in enumerate(TEMPLATES)]
    grams = ", ".join(f"({t}, {j}, '{w[j]}', '{w[j + 1]}', '{w[j + 2]}')" for t, _, w in words for j in range(len(w) - K + 1))
    known = ", ".join(f"({t}, '{label}', {len(w)})" for t, label, w in words)
    phrase = "".join(f" WHEN {' AND '.join(f'{c} = {chr(39)}{w}{chr(39)}' for c, w in zip('abc', p.split(' '), strict=False))} THEN '{label}'" for p, label in PHRASES.items())
    return f"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, i - 1 AS i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM split)),
bases AS (SELECT * FROM (SELECT doc_id, i, CASE{phrase} END AS label FROM places) WHERE label IS NOT NULL),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM bases GROUP BY doc_id),
grams(t, j, x, y, z) AS (VALUES {grams}),
known(t, label, len) AS (VALUES {known}),
diagonals AS (
  SELECT doc_id, t, label, len, i - j AS d, list(j) AS js, min(i) AS lo, max(i) AS hi
  FROM places JOIN grams ON a = x AND b = y AND c = z JOIN known USING (t) GROUP BY ALL),
steps AS (
  SELECT *, coalesce(d - lag(d) OVER w > 3 OR lo - lag(lo) OVER w > len + 3, true)::INT AS fresh FROM diagonals WINDOW w AS (PARTITION BY doc_id, t ORDER BY d, lo)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY d, lo) AS run FROM steps),
covered AS (SELECT doc_id, t, label, len, run, count(DISTINCT j + k) AS n FROM (SELECT doc_id, t, label, len, run, unnest(js) AS j FROM runs), range({K}) AS r(k) GROUP BY ALL),
places_of AS (SELECT doc_id, t, run, min(lo) AS a, max(hi) + {K} AS b FROM runs GROUP BY ALL),
verified AS (SELECT doc_id, label, len, a, b, round(n / len, 6) AS cover FROM covered JOIN places_of USING (doc_id, t, run) WHERE round(n / len, 6) >= 0.8),
spans AS (SELECT doc_id, label, cover FROM verified s WHERE NOT EXISTS (FROM verified l WHERE l.doc_id = s.doc_id AND l.len > s.len AND l.a <= s.a AND l.b >= s.b)),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bases UNION ALL SELECT doc_id, label FROM spans) GROUP BY doc_id),
base_labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bases GROUP BY doc_id),
best AS (SELECT doc_id, max(cover) AS cover FROM spans GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN base_labels IS NOT NULL THEN 1.0 ELSE coalesce(cover, 0) END::DOUBLE AS score
FROM split LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN base_labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""


OP8_SQL = _sql()
