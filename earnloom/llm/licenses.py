"""Operator 4: licence notices by MinHash bands over text windows.

A template of m words (A-Z lowered; digits, a-z and beyond ASCII are letters) has shingles of k = min(5, m)
words. Texts are cut for it into windows of 2m words that start at multiples of m, so every occurrence
lies whole in one. A window's shingles give BANDS MinHash coordinates, one per band: a window that holds
the template has similarity of at least 1 / (k + 1), and is missed by all 64 bands less than once in
100,000. Retrieved templates are confirmed exactly: at least CONTAINED percent of the template's shingles
stand in the window.

Only windows around pivot words are looked at, which loses nothing: a template's pivots are chosen so that
a window without any of them lacks more shingles than may be lacking. Texts without a pivot are left out
by one pass of a pattern. Templates are a parameter of fixed size; all their tables are broadcast.

Null and empty texts carry no template; a text shorter than a window is one window; rows of one id are
joined to one row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earnloom.llm.registry import query
from earnloom.llm.words import LOWER, read, text_of

SHINGLE, BANDS, CONTAINED = 5, 64, 80
# Notices as they stand in documents.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if w]


def pivots(words: list[str], contained: int = CONTAINED) -> list[str]:
    """Words without any of which a window cannot hold ``contained`` percent of the shingles."""
    k = min(SHINGLE, len(words))
    shingles: dict[tuple, set] = {}
    for i in range(len(words) - k + 1):
        shingles.setdefault(tuple(words[i : i + k]), set(words[i : i + k]))
    chosen, gone = [], set()
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        chosen.append(word)
        gone |= {s for s, held in shingles.items() if word in held}
        if 100 * (len(shingles) - len(gone)) < contained * len(shingles):
            break
    return chosen


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body's own loops use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(words: Column, k: Column) -> Column:
    """Distinct shingles of a word array; none if it has fewer words than a shingle."""

    def made(held: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(held) - k + 1)
        found = F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(held, i, k), " ")))
        return F.when(F.size(held) >= k, found).otherwise(F.array().cast("array<string>"))

    return _bound(words, made)


def _bands(shingles: Column) -> Column:
    """MinHash coordinates: for each band the smallest seeded hash of the shingles."""

    def made(held: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)),
            lambda j: F.struct(j.alias("band"), F.array_min(F.transform(held, lambda s: F.xxhash64(s, j))).alias("key")),
        )

    return _bound(shingles, made)


def _table(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A small table from literals, which needs no Python worker to be read."""

    def cell(value) -> Column:
        return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)

    listed = [F.struct(*[cell(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*listed)))


def template_tables(spark: SparkSession, templates: Mapping[str, str], contained: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(template, m, k, shingles, bands), (pivot, m, k) and all pivots."""
    rows, by_pivot = [], set()
    for name, text in sorted(templates.items()):
        found = template_words(text)
        if not found:
            continue
        m, k = len(found), min(SHINGLE, len(found))
        rows.append((name, found, m, k))
        by_pivot |= {(p, m, k) for p in pivots(found, contained)}
    if not rows:
        raise ValueError("no template has a word")
    table = _table(spark, rows, ("template", "w", "m", "k"))
    table = table.withColumn("_template_shingles", _shingles(F.col("w"), F.col("k"))).withColumn(
        "_keys", _bands(F.col("_template_shingles"))
    )
    return table.drop("w"), _table(spark, sorted(by_pivot), ("pivot", "m", "k")), sorted({p for p, _, _ in by_pivot})


def notices(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, contained: int = CONTAINED, key: str = "doc_id") -> DataFrame:
    """(key, template, start): the confirmed windows; ``start`` counts words from 0."""
    table, by_pivot, all_pivots = template_tables(docs.sparkSession, templates, contained)
    letter = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
    near = "|".join(re.escape(p) for p in all_pivots)
    hopeful = (
        docs.select(F.col(key).alias("_id"), text_of().alias("_text"))
        .filter(F.col("_text").rlike(f"(?i)(?<!{letter})(?:{near})(?!{letter})"))
        .select("_id", F.array_remove(F.split(F.expr(LOWER.format("_text")), _SPLIT), "").alias("_words"))
    )
    listed = F.array(*[F.lit(p) for p in all_pivots])
    places = F.filter(
        F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("pivot"))),
        lambda x: F.array_contains(listed, x["pivot"]),
    )
    at, m = F.col("_place.at"), F.col("m")
    whole = F.floor(at / m).cast("int") * m
    starts = F.filter(F.array(whole - m, whole), lambda s: s >= 0)
    windows = (
        hopeful.withColumn("_place", F.explode(places))
        .withColumn("_pivot", F.col("_place.pivot"))
        .join(F.broadcast(by_pivot.withColumnRenamed("pivot", "_pivot")), "_pivot")
        .withColumn("start", F.explode(starts))
        .select("_id", "m", "k", "start", F.slice("_words", F.col("start") + 1, 2 * m).alias("_window"))
        .dropDuplicates(["_id", "m", "k", "start", "_window"])
        .withColumn("_shingles", _shingles(F.col("_window"), F.col("k")))
        .filter(F.size("_shingles") > 0)
        .select("_id", "m", "k", "start", "_shingles", _bands(F.col("_shingles")).alias("_window_keys"))
    )
    keyed = table.select("template", "m", "k", "_template_shingles", F.explode("_keys").alias("_cell"))
    return (
        windows.withColumn("_cell", F.explode("_window_keys"))
        .drop("_window_keys")
        .join(F.broadcast(keyed), ["m", "k", "_cell"])
        .filter(
            100 * F.size(F.array_intersect("_template_shingles", "_shingles")) >= contained * F.size("_template_shingles")
        )
        .select(F.col("_id").alias(key), "template", "start")
        .distinct()
    )


def scanned(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per id: ``n_templates`` and ``templates`` (names in order, comma-joined)."""
    found = (
        notices(docs, key=key, **options)
        .groupBy(F.col(key).alias("_id"))
        .agg(F.array_sort(F.collect_set("template")).alias("_names"))
    )
    ids = docs.select(key).distinct()
    return ids.join(found, F.col(key) == F.col("_id"), "left").select(
        key,
        F.coalesce(F.size("_names"), F.lit(0)).cast("long").alias("n_templates"),
        F.coalesce(F.array_join("_names", ","), F.lit("")).alias("templates"),
    )


def _sql() -> str:
    rows = ", ".join(f"('{n}', {template_words(t)!r})" for n, t in sorted(TEMPLATES.items()))
    grams = "list_distinct(list_transform(range(1, len({0}) - k + 2), lambda i: array_to_string({0}[i:i + k - 1], ' ')))"
    return f"""
WITH template AS (
  SELECT name, w, len(w) AS m, least({SHINGLE}, len(w)) AS k FROM (VALUES {rows}) t(name, w)),
tgrams AS (SELECT name, m, k, {grams.format("w")} AS g FROM template),
doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
sizes AS (SELECT DISTINCT m, k FROM template),
wins AS (
  SELECT doc_id, m, k, unnest(list_transform(range(0, len(w) // m + 1), lambda s: w[s * m + 1:s * m + 2 * m])) AS win
  FROM doc, sizes),
wgrams AS (SELECT doc_id, m, k, {grams.format("win")} AS g FROM wins WHERE len(win) >= k),
found AS (
  SELECT DISTINCT doc_id, name FROM wgrams x JOIN tgrams t ON x.m = t.m AND x.k = t.k
  WHERE 100 * len(list_intersect(x.g, t.g)) >= {CONTAINED} * len(t.g)),
named AS (
  SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(name)), ',') AS names FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_templates, coalesce(names, '') AS templates
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN named USING (doc_id)
"""


@query("op4_license_bands", _sql())
def license_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents").select("doc_id", "text"))
