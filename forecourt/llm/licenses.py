"""License scan: MinHash bands over overlapping text windows, then exact containment; DataFrame expressions only.

Words are lower-case runs of letters and digits, shingles are five of them. A template of L
shingles is looked for in windows of w = 2 * s shingles every s, s the next power of two: any
stretch of L shingles lies whole in some window. Each of ``bands(...)`` bands is the minimum
of one hash over a window's shingles; a window that holds ``CONTAINED`` of the template
agrees with it in some band with probability 1 - ``MISS`` at least. A window can agree in a
band only if it holds the very shingle that gives the template's minimum, so bands are
computed for windows with such a shingle alone: the result is that of all windows. Retrieved
pairs are kept if the window's shingles hold ``CONTAINED`` of the template's.

Templates are a short list given by the caller, of five words at least (else ValueError).
Null and empty texts match nothing. Rows that share a doc_id give one row per license, their
best one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-6

#: Short notices of public licenses, as they are commonly given.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


def words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def _starts(count: Column) -> Column:
    return F.greatest(count - (SHINGLE - 1), F.lit(0))


def shingle_hashes(column: str = "words") -> Column:
    """Over an array column of words."""
    rest = [lambda i, k=k: F.get(column, i + k) for k in range(1, SHINGLE)]
    return F.transform(F.slice(column, 1, _starts(F.size(column))), lambda w, i: F.xxhash64(w, *[r(i) for r in rest]))


def shingle_texts(column: str = "words") -> Column:
    return F.transform(F.slice(column, 1, _starts(F.size(column))), lambda w, i: F.array_join(F.slice(column, i + 1, SHINGLE), " "))


def stride(size: int) -> int:
    return 1 << (size - 1).bit_length()


def bands(size: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    """Bands of one hash each, so that a window holding ``contained`` of a template is missed with probability ``miss`` at most."""
    held = math.ceil(contained * size)
    alike = held / (2 * stride(size) + size - held)  # Jaccard similarity at least
    return 1 if alike >= 1 else math.ceil(math.log(miss) / math.log(1 - alike))


def _sketch(hashes: Column, count: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.array_min(F.transform(hashes, lambda x: F.xxhash64(b, x))))


def prepared(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """A row per template and band: (template, license, shingles, n, s, band, least, holders)."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.withColumn("words", words(F.col("text"))).withColumns({"shingles": F.array_distinct(shingle_texts()), "hashes": F.array_distinct(shingle_hashes())})
    known = rows.select("template", "license", "shingles", "hashes").collect()  # the caller's own short list
    if not all(t.hashes for t in known):
        raise ValueError(f"a template needs {SHINGLE} words at least")
    listed = [(*t, len(t.hashes), stride(len(t.hashes))) for t in known]
    each = spark.createDataFrame(listed, "template int, license string, shingles array<string>, hashes array<bigint>, n int, s int")
    each = each.select("*", F.posexplode(_sketch(F.col("hashes"), max(bands(n) for *_, n, _ in listed))).alias("band", "least"))
    return each.select("*", F.filter("hashes", lambda x: F.xxhash64(F.col("band"), x) == F.col("least")).alias("holders")).drop("hashes")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """(doc_id, license, containment, first_word): best containment and first word of a match, counted from 0."""
    known = prepared(docs.sparkSession, templates)
    seeds = {r.s: sorted(r.h) for r in known.select("s", F.explode("holders").alias("h")).groupBy("s").agg(F.collect_set("h").alias("h")).collect()}
    count = known.agg(F.max("band")).first()[0] + 1
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    split = split.select("doc_id", "words", shingle_hashes().alias("h"))
    # No filter on "h": it would be pushed below and split the text again for every word.
    split = split.select("doc_id", "words", "h", *[_windows(s, own).alias(f"w{s}") for s, own in seeds.items()])
    windows = split.select("doc_id", "words", "h", F.explode(F.concat(*[f"w{s}" for s in seeds])).alias("w"))
    start = F.col("w.j") * F.col("w.s")
    windows = windows.select(
        "doc_id", start.alias("start"), "w.s", F.slice("words", start + 1, 2 * F.col("w.s") + SHINGLE - 1).alias("words"), F.slice("h", start + 1, 2 * F.col("w.s")).alias("h")
    )
    banded = windows.select("doc_id", "start", "s", "words", F.posexplode(_sketch(F.col("h"), count)).alias("band", "least"))
    hits = banded.join(F.broadcast(known.drop("holders")), ["s", "band", "least"])  # the caller's own short list
    hits = hits.select("doc_id", "start", "words", "template", "license", "shingles", "n").distinct().withColumn("own", shingle_texts())
    share = F.size(F.array_intersect("own", "shingles")) / F.col("n")
    first = F.array_min(F.filter(F.transform("own", lambda x, i: F.when(F.array_contains("shingles", x), i)), lambda i: i.isNotNull()))
    held = hits.select("doc_id", "license", share.alias("containment"), (F.col("start") + first).alias("first_word")).where(F.col("containment") >= CONTAINED)
    return held.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"))


def _windows(s: int, seeds: Sequence[int]) -> Column:
    """Windows of 2 * s shingles with one of ``seeds``, as (s, j): window j begins at shingle j * s."""
    near = F.arrays_overlap("h", F.array(*map(F.lit, seeds)))
    at = F.filter(F.transform("h", lambda x, i: F.when(x.isin(*seeds), F.floor(i / s).cast("int"))), lambda j: j.isNotNull())
    both = F.array_distinct(F.flatten(F.transform(at, lambda j: F.array(j - 1, j))))
    found = F.transform(F.filter(both, lambda j: j >= 0), lambda j: F.struct(F.lit(s).alias("s"), j.alias("j")))
    return F.when(near, found).otherwise(F.array().cast("array<struct<s:int,j:int>>"))
