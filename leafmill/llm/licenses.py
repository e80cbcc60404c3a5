"""Licence notices in documents, found by MinHash bands over windows and verified exactly.

Words are runs of letters and digits in lower case; a shingle is three words. A template of n
words is looked for in windows of 5/4 L words that begin at every multiple of L/4, L being the
power of two from n up, at least 8: any place of the template lies whole in at least one window,
and makes up at least 2/5 of that window's shingles once it is there whole. With ``BANDS`` bands of one minimum each, a window
misses its template with a chance under (3/5) ** 48 < 3e-11. Candidates count if the window holds
at least ``CONTAINMENT`` of the template's distinct shingles.

Windows with too few shingles known from any template to reach that share are left out before
the signatures: they can never match, so this drops no result.

Everything is built-in expressions. Templates are a parameter; they, not the data, bound what is
broadcast. Defined results: null, empty and shorter texts hold no licence and give no row; repeated
rows give repeated results; one row per document row and licence, with the best containment, the first
of equal ones; texts of any length are read whole; a null doc_id stays; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import let
from leafmill.llm.batches import fresh

SHINGLE = 3
BANDS = 48
CONTAINMENT = 0.75
SMALLEST = 8

# Wording of common licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at"
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met:"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hash of every run of ``SHINGLE`` words, by its place; no array for fewer words."""
    return F.when(
        F.size(words) >= SHINGLE,
        F.transform(
            F.slice(words, F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, SHINGLE))),
        ),
    )


def minima(shingles: Column) -> Column:
    """One minimum per band over differently seeded hashes of the shingles."""
    def minimum(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(band))))

    return F.array(*map(minimum, range(BANDS)))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license_id, size, shingles, grams``: L of each template and its distinct shingles.

    Templates of fewer than ``SHINGLE`` words cannot be told from chance and are refused.
    """
    rows = spark.sql("SELECT explode(map({})) AS (license_id, text)".format(
        ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in templates.items())
    ))
    words = rows.withColumn("words", words_of(F.col("text")))
    n = F.size("words")
    size = F.greatest(F.pow(F.lit(2), F.ceil(F.log2(n.cast("double")))).cast("int"), F.lit(SMALLEST))
    return words.select(
        "license_id", size.alias("size"), F.array_distinct(shingles_of(F.col("words"))).alias("shingles"), n.alias("words")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text",
         containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license_id, containment, first_word, n_windows`` of the licences in every whole text.

    ``first_word`` is the place (from 0) where the first window with the best containment begins.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates or TEMPLATES)
    # bounded by the templates: their shingles, as constants of the plan
    rows = known.collect()
    if short := [r.license_id for r in rows if not r.shingles]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    wanted = sorted({s for r in rows for s in r.shingles})
    sizes = sorted({r["size"] for r in rows})
    least = {L: min(-(-int(containment * len(r.shingles) * 1000) // 1000) for r in rows if r["size"] == L) for L in sizes}

    row, sh, hit = fresh("row"), fresh("shingles"), fresh("hits")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn(row, F.monotonically_increasing_id())
    hashed = source.select("doc_id", row, let(words_of(F.col("text")), shingles_of).alias(sh))
    marks = F.filter(F.transform(sh, lambda s, i: F.when(s.isin(wanted), i)), lambda i: i.isNotNull())
    held = hashed.withColumn(hit, marks).filter(F.size(hit) > 0)

    def windows(L: int) -> Column:
        """Beginnings of the windows of class L with enough known shingles."""
        step, span = L // 4, L + L // 4 - (SHINGLE - 1)
        begins = F.array_distinct(F.flatten(F.transform(hit, lambda h: F.transform(
            F.sequence(F.greatest(F.ceil((h - (span - 1)) / F.lit(step)), F.lit(0)).cast("int"), F.floor(h / F.lit(step)).cast("int")),
            lambda k: k * step,
        ))))
        cut = F.transform(begins, lambda b: F.struct(F.lit(L).alias("size"), b.alias("at"), F.slice(F.col(sh), b + 1, F.lit(span)).alias("grams")))
        return F.filter(cut, lambda w: F.size(F.filter(w.grams, lambda s: s.isin(wanted))) >= max(1, least[L]))

    found = held.select("doc_id", row, F.explode(F.concat(*map(windows, sizes))).alias("w")).select("doc_id", row, "w.*")
    banded = found.select("*", F.posexplode(minima(F.col("grams"))).alias("band", "value"))
    bands = known.select("license_id", "size", F.col("shingles").alias("template"), F.posexplode(minima(F.col("shingles"))).alias("band", "value"))
    # at most BANDS rows per template
    pairs = banded.join(F.broadcast(bands), ["size", "band", "value"])
    share = F.size(F.array_intersect("template", "grams")) / F.size("template")
    verified = pairs.select("doc_id", row, "license_id", "at", share.alias("share")).filter(F.col("share") >= containment)
    best = F.max(F.struct("share", (-F.col("at")).alias("at")))
    return verified.groupBy(row, "doc_id", "license_id").agg(best.alias("best"), F.count_distinct("at").alias("n_windows")).select(
        "doc_id", "license_id", F.col("best.share").alias("containment"), (-F.col("best.at")).cast("long").alias("first_word"), "n_windows"
    )
