"""Licence notices found by the Dice coefficient over word bigrams.

Texts are lower-cased and everything but letters and digits becomes a space. A span of
consecutive words matches a template if twice the number of distinct word bigrams they share is
at least ``THRESHOLD`` times the sum of their distinct bigrams; a notice is found wherever it
stands, whatever surrounds it on its line. That needs sizes that differ by a bounded factor: a
span has at most ``most`` bigrams of a template's size times that factor, and a stretch of twice
as many is looked at only if enough different bigrams of the template occur in it.

Of the spans of a template whose starts are no further apart than its size the best stays (of
equal ones the first).
Spans that overlap make a place, and a place has the licences of its highest coefficient, ties
all.

Null and empty texts have no spans; an empty table gives no rows. Long texts are compared whole.
Rows are told apart by their place, so null or repeated doc_ids and repeated rows each give their
own result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import bound
from .tables import keyed, written

THRESHOLD = 0.8

# The notices that public licences ask for, and the texts of the short ones.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the "
        "LICENSE file.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
    ],
}


def bigrams(text: str) -> set[str]:
    found = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return {f"{a} {b}" for a, b in zip(found, found[1:])}


def size_bounds(size: int, threshold: float) -> tuple[float, float]:
    """Sizes that a unit may have to reach the threshold against a template of ``size``."""
    ratio = (2 - threshold) / threshold
    return size / ratio - 1e-9, size * ratio + 1e-9


def template_rows(templates: Mapping[str, list[str]], threshold: float) -> list[tuple]:
    """kind, licence, size, fewest shared bigrams, most bigrams of a span, bigram."""
    rows = []
    texts = [(licence, text) for licence, some in templates.items() for text in some]
    for kind, (licence, text) in enumerate(texts):
        grams = bigrams(text)
        low, high = size_bounds(len(grams), threshold)
        rows += [(kind, licence, len(grams), low, int(high), gram) for gram in sorted(grams)]
    return rows


def pairs_of(words: Column) -> Column:
    """The bigrams of an array of words, in order."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)),
    )


def best_span(pairs: Column, known: Column, size: Column) -> Column:
    """dice and length of the best span that starts with the first of the pairs, shortest of ties."""
    seen = F.transform(
        pairs,
        lambda x, i: F.struct(
            (F.array_position(pairs, x) == i + 1).alias("fresh"), F.array_contains(known, x).alias("shared")
        ),
    )

    def longer(acc: Column, x: Column) -> Column:
        own = acc.own + F.when(x.fresh, 1).otherwise(0)
        common = acc.common + F.when(x.fresh & x.shared, 1).otherwise(0)
        dice = F.lit(2.0) * common / (own + size)
        better = dice > acc.dice
        return F.struct(
            own.alias("own"),
            common.alias("common"),
            (acc.n + 1).alias("n"),
            F.when(better, dice).otherwise(acc.dice).alias("dice"),
            F.when(better, acc.n + 1).otherwise(acc.length).alias("length"),
        )

    zero = [F.lit(0).alias(n) for n in ("own", "common", "n")]
    start = F.struct(*zero, F.lit(0.0).alias("dice"), F.lit(0).alias("length"))
    return F.aggregate(seen, start, longer, lambda acc: F.struct(acc.dice.alias("dice"), acc.length.alias("length")))


def spans(
    docs: DataFrame,
    templates: Mapping[str, list[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(row, doc_id, kind, licence, size, start, length, dice): the best span of every start that matches.

    ``start`` is the place of a word, ``length`` the number of its bigrams.
    """
    spark: SparkSession = docs.sparkSession
    # As many rows as the given templates have bigrams: a size the caller fixes.
    known = spark.createDataFrame(
        template_rows(templates, threshold),
        "kind int, licence string, size int, low double, most int, bigram string",
    )
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    texts = keyed(docs, "doc_id", "text").select("row", "doc_id", F.split(plain, " ").alias("words"))
    block = F.floor(F.col("at") / F.col("most")).cast("int")
    stretches = written(
        texts.select("row", F.posexplode(bound(F.col("words"), pairs_of)).alias("at", "bigram"))
        .join(F.broadcast(known), "bigram")
        # A span starts in one block and ends in it or the next.
        .select("row", "kind", "low", "bigram", F.explode(F.array(block, block - 1)).alias("block"))
        .groupBy("row", "kind", "low", "block")
        .agg(F.size(F.collect_set("bigram")).alias("common"))
        .filter((F.col("common") >= F.col("low")) & (F.col("block") >= 0))
        .select("row", "kind", "block"),
        "licence-stretches",
    )
    whole = known.groupBy("kind", "licence", "size", "most").agg(F.collect_list("bigram").alias("known"))
    stretch = F.slice("words", F.col("block") * F.col("most") + 1, F.col("most") * 2 + 1)
    # Spark sends the stretches to all tasks only if their files are small.
    starts = (
        texts.join(stretches, "row")
        .join(F.broadcast(whole), "kind")
        .select("row", "doc_id", "kind", "licence", "size", "most", "known", "block", pairs_of(stretch).alias("pairs"))
        .select("*", F.posexplode(F.slice("pairs", 1, F.col("most"))).alias("at", "first"))
        .filter(F.array_contains("known", F.col("first")))
        .withColumn("pairs", F.slice("pairs", F.col("at") + 1, F.col("most")))
        .withColumn("best", bound(F.col("pairs"), lambda x: best_span(x, F.col("known"), F.col("size"))))
    )
    start = F.col("block") * F.col("most") + F.col("at")
    return starts.filter(F.col("best.dice") >= threshold).select(
        "row", "doc_id", "kind", "licence", "size", start.alias("start"), "best.length", "best.dice"
    )


def matches(docs: DataFrame, **options) -> DataFrame:
    """(row, doc_id, place, licence, start, length, dice) of every place and its best licences."""
    near = Window.partitionBy("row", "kind").orderBy(F.col("start") / F.col("size")).rangeBetween(-1, 1)
    rank = F.struct("dice", -F.col("start"))
    alone = spans(docs, **options).withColumn("top", F.max(rank).over(near) == rank).filter("top")
    in_text = Window.partitionBy("row").orderBy("start", "kind")
    # The word after the last one of a span.
    reached = F.max(F.col("start") + F.col("length") + 1).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") < F.col("reached"), 0).otherwise(1)
    placed = alone.withColumn("reached", reached).withColumn("place", F.sum(opens).over(in_text))
    best = F.max("dice").over(Window.partitionBy("row", "place"))
    return (
        placed.withColumn("best", best)
        .filter(F.col("dice") == F.col("best"))
        .select("row", "doc_id", "place", "licence", "start", "length", "dice")
    )


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, licence, number of its places, best coefficient; one row per pair found."""
    return (
        matches(docs, **options)
        .groupBy("row", "doc_id", "licence")
        .agg(F.countDistinct("place").alias("n_units"), F.round(F.max("dice"), 6).alias("dice"))
        .drop("row")
    )


def oracle() -> str:
    rows = ",".join(
        f"({kind},'{licence}',{size},{most},'{gram}')"
        for kind, licence, size, _, most, gram in template_rows(TEMPLATES, THRESHOLD)
    )
    return rf"""
WITH known(kind, licence, size, most, bigram) AS (VALUES {rows}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS ws
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT rid, doc_id, i, ws[i] || ' ' || ws[i + 1] AS bigram
  FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM d)
), h AS (
  SELECT rid, doc_id, kind, licence, size, most, i AS p FROM b JOIN known USING (bigram)
), c AS (
  SELECT * FROM h
  QUALIFY 3 * count(*) OVER (
    PARTITION BY rid, kind ORDER BY p RANGE BETWEEN CURRENT ROW AND most FOLLOWING) >= 2 * size
), x AS (
  SELECT h.*, b.i, b.bigram, k.bigram IS NOT NULL AS shared
  FROM c h JOIN b ON b.rid = h.rid AND b.i BETWEEN h.p AND h.p + h.most - 1
  LEFT JOIN known k ON k.kind = h.kind AND k.bigram = b.bigram
), f AS (
  SELECT *, row_number() OVER (PARTITION BY rid, kind, p, bigram ORDER BY i) = 1 AS fresh FROM x
), s AS (
  SELECT *, 2.0::DOUBLE * sum(CAST(fresh AND shared AS INT)) OVER w / (sum(CAST(fresh AS INT)) OVER w + size) AS dice
  FROM f WINDOW w AS (PARTITION BY rid, kind, p ORDER BY i)
), t AS (
  SELECT * FROM s WHERE dice >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY rid, kind, p ORDER BY dice DESC, i) = 1
), a AS (
  SELECT * FROM t WHERE NOT EXISTS (
    SELECT 1 FROM t o WHERE o.rid = t.rid AND o.kind = t.kind AND abs(o.p - t.p) <= t.size
      AND (o.dice > t.dice OR (o.dice = t.dice AND o.p < t.p)))
), r AS (
  SELECT *, max(i + 2) OVER (PARTITION BY rid ORDER BY p, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
  FROM a
), q AS (
  SELECT *, sum(CASE WHEN p < reached THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p, kind) AS place FROM r
), best AS (
  SELECT * FROM q QUALIFY dice = max(dice) OVER (PARTITION BY rid, place)
)
SELECT doc_id, licence, count(DISTINCT place) AS n_units, round(max(dice), 6) AS dice
FROM best GROUP BY rid, doc_id, licence
"""
