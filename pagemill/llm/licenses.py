"""License scan with MinHash bands over overlapping text windows, in DataFrame functions only.

A template is a license notice. Texts are lower-case words; a shingle is five words in a row, or
the whole notice if it is shorter. Windows overlap by half and hold at least twice the longest
template's shingles, so every occurrence lies whole in one window. A band is the least value of
one hash function over the shingles of a window, and so of a template.

For a template of s shingles whose share c is in a window of w shingles, a band of one row agrees
with probability c s / (w + s - c s) at least. `bands` takes as many bands for each template size
as make the probability of no agreement `miss` or less, and windows are as short as the size class
of the templates allows, so that short notices do not drown: templates are put into classes by
their number of shingles (1, 2, 4, 8, ...), each with its windows.

A band of a window can agree with a template's only on a shingle that both hold. So documents
without a shingle of any template have no candidates in any band, and are left out before windows
are built. Candidates are verified by exact shingle containment in the window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import bind
from pagemill.session import cut

WORDS = 5
SIMILARITY = 0.8
MISS = 1e-6

# Short notices of well-known licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(text: Column) -> Column:
    """The hashes of five words in a row, in order; none for fewer words."""
    return bind(
        words(text),
        lambda found: F.when(
            F.size(found) >= WORDS,
            F.transform(F.sequence(F.lit(1), F.size(found) - (WORDS - 1)), lambda i: F.xxhash64(F.slice(found, i, WORDS))),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, its distinct shingles, and the size class: windows of that class move by `stride`."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, notice string")
    found = rows.select("license", F.array_distinct(shingles(F.col("notice"))).alias("notice_shingles"))
    size = F.size("notice_shingles")
    return found.withColumn("stride", F.pow(F.lit(2), F.ceil(F.log2(size))).cast("int"))


def bands_needed(least: int, stride: int, similarity: float, miss: float) -> int:
    """Bands of one row by which a notice of `least` shingles or more is missed at most so often."""
    shared = math.ceil(similarity * least - 1e-9)
    agree = shared / (2 * stride + least - shared)
    return max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def band_values(found: Column, bands: int) -> Column:
    """The least value of each of the hash functions 1 .. bands over a list of shingles."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(bands)),
        lambda k: F.struct(k.alias("band"), F.array_min(F.transform(found, lambda x: F.xxhash64(x, k))).alias("value")),
    )


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, similarity: float = SIMILARITY, miss: float = MISS
) -> DataFrame:
    """(doc_id, license, containment): notices of which a window holds `similarity` or more.

    The containment is the largest of the document's windows. Null and short texts hold nothing;
    rows that share an id, or have none, give one row per license. A notice needs five words.
    """
    spark = docs.sparkSession
    notices = template_table(spark, TEMPLATES if templates is None else templates)
    # The templates are a parameter, not data: their shingles are literals of the plan.
    known = notices.collect()
    if not known:
        return docs.select(F.col("doc_id").cast("long"), F.lit("").alias("license"), F.lit(0.0).alias("containment")).limit(0)
    if any(not row.notice_shingles for row in known):
        raise ValueError(f"a notice needs {WORDS} words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body"))
    every = sorted({x for row in known for x in row.notice_shingles})
    # Few documents, with their shingles: written once, for the classes of window sizes to share.
    near = cut(rows.select("doc_id", shingles(F.col("body")).alias("found")).filter(F.arrays_overlap("found", _longs(every))))
    parts = []
    for stride in sorted({row.stride for row in known}):
        own = [row for row in known if row.stride == stride]
        bands = bands_needed(min(len(row.notice_shingles) for row in own), stride, similarity, miss)
        hashes = _longs(sorted({x for row in own for x in row.notice_shingles}))
        starts = F.sequence(F.lit(0), F.size("found") - 1, F.lit(stride))
        windows = (
            near.filter(F.arrays_overlap("found", hashes))
            .select("doc_id", "found", F.explode(starts).alias("start"))
            .select("doc_id", "start", F.slice("found", F.col("start") + 1, 2 * stride).alias("window_shingles"))
            .filter(F.arrays_overlap("window_shingles", hashes))
            .select("doc_id", "start", "window_shingles", F.explode(band_values(F.col("window_shingles"), bands)).alias("b"))
        )
        index = (
            notices.filter(F.col("stride") == stride)
            .select("license", "notice_shingles", F.explode(band_values(F.col("notice_shingles"), bands)).alias("t"))
        )
        # At most templates x bands rows.
        hits = windows.join(F.broadcast(index), F.col("b") == F.col("t")).dropDuplicates(["doc_id", "start", "license", "window_shingles"])
        shared = F.size(F.array_intersect("window_shingles", "notice_shingles"))
        parts.append(hits.select("doc_id", "license", (shared / F.size("notice_shingles")).alias("containment")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.filter(F.col("containment") >= similarity).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("bigint") for x in values])


def oracle(templates: dict[str, str], similarity: float = SIMILARITY) -> str:
    """The same rows in DuckDB, by shingle positions instead of bands."""
    notices = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in sorted(templates.items()))
    return f"""
    WITH notice(license, body) AS (VALUES {notices}),
    part AS (
        SELECT license, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
        FROM notice
    ),
    own AS (
        SELECT DISTINCT license, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
        FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM part)
    ),
    sized AS (
        SELECT *, cast(pow(2, ceil(log2(n))) AS BIGINT) AS stride
        FROM (SELECT *, count(*) OVER (PARTITION BY license) AS n FROM own)
    ),
    body AS (
        SELECT doc_id, row_number() OVER () AS row_id,
            list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    place AS (
        SELECT doc_id, row_id, i - 1 AS pos, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
        FROM (SELECT doc_id, row_id, w, unnest(range(1, len(w) - 3)) AS i FROM body)
    ),
    hit AS (
        SELECT doc_id, row_id, license, n, shingle, unnest([pos // stride, pos // stride - 1]) AS win
        FROM place JOIN sized USING (shingle)
    )
    SELECT doc_id, license, max(containment) AS containment FROM (
        SELECT doc_id, row_id, license, win, count(DISTINCT shingle) / n AS containment
        FROM hit WHERE win >= 0 GROUP BY doc_id, row_id, license, win, n
    ) WHERE containment >= {similarity} GROUP BY doc_id, license
    """
