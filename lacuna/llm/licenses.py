"""License scans by MinHash bands over overlapping windows, in column expressions only.

Texts are words (lower case, runs of letters and digits). Windows of ``width`` words overlap by half,
so a notice of up to half a window lies whole in one of them, and the windows of a longer notice hold
it together. Every window and every template (a longer template is cut into windows of its own) gets
``bands`` bands of ``rows`` MinHash values of its five-word shingles, or as many more as the templates
need: the seeds are fixed, so a template's least hash u (of 0 to 1) of every band is known, and the
w - s other shingles of a window of w that holds its s all lie above with probability
(1 - u)^(w - s). Bands are added until every template inside one full window is missed with
probability ``miss`` at most. Colliding templates are verified: the share of their shingles that the text's candidate
windows hold, exactly, is at least ``containment``.

A MinHash value with one row that collides is a shingle both have. So only windows with a shingle of
some template are hashed; the others cannot collide, and nothing is lost.

Templates have at least five words; shorter ones are refused. NULL texts are empty. Rows and ids may
repeat or be NULL; extra columns are ignored; a text without a license gives no row in ``licenses``
and an empty list in the query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.base import documents, keep, table

#: Short notices of well-known licenses.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    width: int = 24
    bands: int = 48
    rows: int = 1
    containment: float = 0.8
    miss: float = 1e-4


def _words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _shingle(words: Column, i: Column, k: int) -> Column:
    """Hash of ``k`` words from position i (from 1)."""
    return F.xxhash64(*[F.element_at(words, i + j) for j in range(k)])


def _lowest(hashes: Column, seed: Column) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, seed)))


def _bands(hashes: Column, s: Settings, n: int) -> Column:
    """The ``n`` band keys of an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.xxhash64(b, *[_lowest(hashes, b * s.rows + r) for r in range(s.rows)]))


def missed(parts: DataFrame, s: Settings, n: int) -> np.ndarray:
    """Per part of a template, and number of bands up to ``n``: the probability that a full window with
    the part in it shares none of the bands."""
    size, _ = _windows(0, s)
    least = F.transform(F.sequence(F.lit(0), F.lit(n * s.rows - 1)), lambda seed: _lowest(F.col("part"), seed))
    out = [np.zeros(n)]
    for r in parts.select(F.size("part").alias("shingles"), least.alias("least")).collect():  # as many rows as parts
        u = (np.array(r.least, float) + 2.0**63) / 2.0**64
        shared = ((1 - u) ** max(0, size - r.shingles)).reshape(n, s.rows).prod(axis=1)
        out.append(np.cumprod(1 - shared))
    return np.array(out)


def bands_needed(parts: DataFrame, s: Settings) -> int:
    """The least number of bands, ``s.bands`` at least, that misses no part more often than ``s.miss``."""
    n = s.bands
    while (chance := missed(parts, s, n))[:, -1].max() > s.miss:
        n *= 2
    return max(s.bands, int((chance.max(axis=0) > s.miss).sum()) + 1)


def _windows(shingles: int, s: Settings) -> tuple[int, int]:
    """(shingles of a window, step)"""
    return s.width - s.shingle + 1, s.width // 2


def templates(spark: SparkSession, notices: list[tuple[str, str]], s: Settings) -> DataFrame:
    """template, license, shingles of every notice."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(notices)], "template int, license string, text string")
    rows = rows.withColumn("words", _words(F.col("text"))).withColumn("n", F.size("words") - s.shingle + 1)
    checked = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("a template has fewer words than a shingle")).cast("int"))
    return rows.select("template", "license", F.array_distinct(F.transform(F.sequence(F.lit(1), checked), lambda i: _shingle(F.col("words"), i, s.shingle))).alias("shingles"))


def licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str]] = NOTICES, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``df``: doc_id and ``found``, an array of (license, template, containment,
    first_word, last_word), words counted from 0, last exclusive, in order."""
    s, spark = settings, df.sparkSession
    known = keep(templates(spark, notices, s), "license-templates")
    listed = known.collect()  # as many rows as notices
    wanted = sorted({h for r in listed for h in r.shingles})
    size, step = _windows(0, s)
    starts, ends = set(), set()
    for _, text in notices:  # words that a shared shingle can begin or end with
        words = spark.sql("SELECT :t AS t", args={"t": text}).select(_words(F.col("t"))).first()[0]
        starts |= set(words[: len(words) - s.shingle + 1])
        ends |= set(words[s.shingle - 1 :])
    words = documents(df, id_col, text_col).select("doc_id", _words(F.col("text")).alias("words"))
    places = F.sequence(F.lit(1), F.size("words") - s.shingle + 1)
    maybe = F.filter(places, lambda i: F.element_at("words", i).isin(*sorted(starts)) & F.element_at("words", i + s.shingle - 1).isin(*sorted(ends)))
    hits = F.filter(F.transform(maybe, lambda i: F.struct(i.alias("at"), _shingle(F.col("words"), i, s.shingle).alias("hash"))), lambda x: x["hash"].isin(*wanted))
    none = F.array().cast("array<struct<at: int, hash: bigint>>")
    words = words.withColumn("hits", F.when(F.size("words") >= s.shingle, hits).otherwise(none))
    # the windows of a hit start at the multiples of ``step`` up to ``size - 1`` before it
    numbers = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(F.greatest(F.lit(0), F.floor((x["at"] - size + step - 1) / step)).cast("int"), F.floor((x["at"] - 1) / step).cast("int")))))

    def window(w: Column) -> Column:
        first = w * step + 1
        last = F.least(first + size - 1, F.size("words") - s.shingle + 1)
        return F.struct(w.alias("number"), F.transform(F.sequence(first, last), lambda i: _shingle(F.col("words"), i, s.shingle)).alias("shingles"))

    windows = F.when(F.size("hits") > 0, F.transform(numbers, window))
    rows = keep(words.select("doc_id", "hits", windows.alias("windows")).withColumn("row", F.monotonically_increasing_id()), "license-windows")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("shingles") - size + step - 1) / step)).cast("int")), lambda w: F.slice("shingles", w * step + 1, F.lit(size)))
    parts = known.select("template", F.explode(cut).alias("part"))
    n = bands_needed(parts, s)
    each = rows.filter("size(hits) > 0").select("row", F.explode("windows").alias("w")).select("row", "w.number", F.explode(_bands(F.col("w.shingles"), s, n)).alias("band"))
    bands = parts.select("template", F.explode(_bands(F.col("part"), s, n)).alias("band")).distinct()
    candidates = each.join(F.broadcast(bands), "band").select("row", "number", "template").distinct()  # rows of bands: notices * windows * bands
    marked = candidates.groupBy("row", "template").agg(F.collect_set("number").alias("numbers"))  # one text's windows
    held = marked.join(F.broadcast(known), "template").join(rows.select("row", "hits"), "row")
    inside = F.filter("hits", lambda x: F.array_contains("shingles", x["hash"]) & F.exists("numbers", lambda w: (x["at"] > w * step) & (x["at"] <= w * step + size)))
    held = held.withColumn("inside", inside)
    share = F.size(F.array_distinct(F.transform("inside", lambda x: x["hash"]))) / F.size("shingles")
    held = held.withColumn("containment", share).filter(F.col("containment") >= s.containment)
    spot = F.transform("inside", lambda x: x["at"])
    one = F.struct((F.array_min(spot) - 1).alias("first_word"), "license", "template", "containment", (F.array_max(spot) - 1 + s.shingle).alias("last_word"))
    found = held.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("found"))
    return rows.select("row", "doc_id").join(found, "row", "left").select("doc_id", F.coalesce("found", F.expr("array()").cast(found.schema["found"].dataType)).alias("found"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    found = licenses(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x.license))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), names.alias("licenses"))


def _oracle() -> str:
    """Whole notices, word for word, in the words of the text."""
    hits = []
    for name, text in NOTICES:
        words = f"' ' || trim(regexp_replace(lower('{text}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
        hits.append(f"SELECT doc_id, n, '{name}' AS license FROM d WHERE contains(words, {words})")
    return (
        "WITH d AS (SELECT doc_id, row_number() OVER () AS n, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS words FROM documents), "
        + "h AS (" + " UNION ALL ".join(hits) + ") "
        + "SELECT d.doc_id, count(h.license) AS n_found, coalesce(string_agg(DISTINCT h.license, ',' ORDER BY h.license), '') AS licenses FROM d LEFT JOIN h USING (n) GROUP BY d.n, d.doc_id"
    )


OP6_SQL = _oracle()
