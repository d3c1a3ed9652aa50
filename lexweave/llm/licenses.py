"""License scans, in DataFrame functions only.

Texts and license templates become sequences of hashed five-word shingles over
lower-cased runs of letters and digits. A text is read in windows of STEP shingles
that begin every STRIDE shingles, so they overlap and every shingle is in two of them.
Templates are read in windows at every offset, so one of them is aligned with
any window of a text that falls into a copy. Each window has BANDS MinHash
bands of one row; a text window that shares a band with a template window
retrieves the template. Bands of one row find windows of similarity J with probability
1 - (1 - J) ** BANDS, and two windows with 1 - (1 - J) ** (2 * BANDS): over 0.99998 at J = 1/4, which is the least that
windows holding one unbroken shingle of a
shorter template can have. Then the share of the template's different shingles that stand in the text around the
alignment is counted exactly and compared with the threshold.

The templates are a parameter and are broadcast: at most MOST_TEMPLATES of at
most MOST_WORDS words. Texts aren't shuffled; only verified matches are, in
groups of one text and one license.

Defined results: null and empty texts match nothing; a text or template of
fewer than five words is one shingle of all its words; templates without words are left out; a
license found at several places of a text is one row with its best
containment and first place; rows with equal ids count as one text; an empty table gives an empty result. Other input columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
STEP = 4
STRIDE = 2
BANDS = 20
MOST_TEMPLATES = 1000
MOST_WORDS = 2000

#: Well-known notices of public licenses; fixed values.
TEMPLATES = (
    ("MIT-notice", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)


def shingles(text: Column) -> Column:
    """Hashes of a text's shingles in order. The words are bound to a lambda's variable, or the text would be split anew for each shingle."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS))))
        ),
    )
    return F.get(hashed, F.lit(0))


def bands(rows: DataFrame, first: Column, step: int) -> DataFrame:
    """Rows with shingles ``h``, for each window's place ``at`` and each band: its key."""
    windows = rows.withColumn("at", F.explode(F.when(F.size("h") > 0, F.sequence(first, F.size("h") - 1, F.lit(step))))).withColumns({f"s{k}": F.get("h", F.col("at") + k) for k in range(STEP)})
    keyed = windows.withColumn("band", F.explode(F.array(*map(F.lit, range(BANDS)))))
    least = F.least(*(F.when(F.col(f"s{k}").isNotNull(), F.xxhash64(f"s{k}", "band")) for k in range(STEP)))
    return keyed.withColumn("key", F.coalesce(least, F.lit(0))).drop(*(f"s{k}" for k in range(STEP)))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """doc_id, license, containment, n_shingles (of the template) and first_word of every license that a text holds."""
    if len(templates) > MOST_TEMPLATES or any(len(t.split()) > MOST_WORDS for _, t in templates):
        raise ValueError(f"at most {MOST_TEMPLATES} templates of at most {MOST_WORDS} words can be broadcast")
    spark = docs.sparkSession
    known = spark.createDataFrame(list(templates), "license string, template string").select("license", shingles(F.col("template")).alias("h"))
    known = bands(known, F.lit(1 - STEP), 1).select("license", F.col("at").alias("offset"), "band", "key", F.size("h").alias("length"), F.array_distinct("h").alias("wanted"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shingles(F.col(text_col).cast("string")).alias("h"))
    found = bands(rows, F.lit(STRIDE - STEP), STRIDE).join(F.broadcast(known), ["band", "key"])
    slack = F.col("length") + STEP
    start = F.col("at") - F.col("offset")
    begin = F.greatest(start - slack, F.lit(0))
    around = F.slice("h", begin + 1, start + F.col("length") + slack - begin)
    share = F.size(F.array_intersect("wanted", around)) / F.size("wanted")
    checked = found.where(start + F.col("length") + slack > 0).select("doc_id", "license", F.size("wanted").alias("n_shingles"), share.alias("containment"), F.greatest(start, F.lit(0)).alias("first_word"))
    return checked.where(F.col("containment") >= threshold).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.first("n_shingles").alias("n_shingles"), F.min("first_word").alias("first_word"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).select("doc_id", "license", F.round("containment", 4).alias("containment"), F.col("n_shingles").cast("long").alias("n_shingles"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The same by comparing every shingle of every text with every shingle of every template.
OP1_SQL = f"""
WITH given(license, template) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEMPLATES)}),
tw AS (SELECT license, regexp_extract_all(lower(template), '[\\p{{L}}\\p{{N}}]+') AS w FROM given),
ts AS (SELECT license, greatest(len(w) - {WORDS - 1}, 1) AS length, unnest(range(0, greatest(len(w) - {WORDS - 1}, 1))) AS o, w FROM tw WHERE len(w) > 0),
t AS (SELECT license, length, o, array_to_string(w[o + 1 : o + {WORDS}], ' ') AS s FROM ts),
size_of AS (SELECT license, count(DISTINCT s) AS n FROM t GROUP BY license),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
dp AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {WORDS - 1}, 1))) AS p FROM dw WHERE len(w) > 0),
d AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + {WORDS}], ' ') AS s FROM dp),
m AS (SELECT d.doc_id, t.license, t.length, d.p, t.o, d.s FROM d JOIN t ON d.s = t.s),
a AS (SELECT DISTINCT doc_id, license, length, p - o AS start FROM m),
c AS (SELECT a.doc_id, a.license, a.start, count(DISTINCT m.s) AS hits FROM a JOIN m ON m.doc_id = a.doc_id AND m.license = a.license
      AND m.p >= a.start - a.length - {STEP} AND m.p < a.start + 2 * a.length + {STEP} GROUP BY a.doc_id, a.license, a.start)
SELECT c.doc_id, c.license, round(max(c.hits / z.n), 4) AS containment, any_value(z.n) AS n_shingles
FROM c JOIN size_of z ON z.license = c.license GROUP BY c.doc_id, c.license HAVING max(c.hits / z.n) >= 0.75
"""
