"""License scans by diagonal voting, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values. Base phrases and their labels: a place counts where the words stand consecutively.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
#: Fixed values. Sentences and whole texts of public licences; a span counts from COVER of a template's k-grams on.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause"),
    ("cc-by-4.0", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3.0", "spdx license identifier gpl 3 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("isc", "spdx license identifier isc"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "spdx license identifier mit"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "spdx license identifier mpl 2 0"),
    ("no-copying", "no part of this work may be reproduced in any form without written permission"),
]
#: Words in a gram, share of a template's grams that a span must show, and diagonals apart that are merged.
GRAM, COVER, DRIFT = 2, 0.8, 2
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _grams(notices: list[tuple[str, str]], k: int) -> list[tuple[int, str, bool, int, int, list[str]]]:
    """(template, label, base, grams, position, words); a template of fewer than k words is one gram."""
    rows = []
    for t, (label, phrase) in enumerate(BASE + notices):
        w = phrase.split()
        n = max(1, len(w) - k + 1)
        rows += [(t, label, t < len(BASE), n, j, w[j : j + k]) for j in range(n)]
    return rows


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", notices: list[tuple[str, str]] = NOTICES, k: int = GRAM) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans), one per row of df.

    Words are runs of letters, digits and non-ASCII characters, lower-cased; null counts as empty:
    no words, no places, empty labels, score 0. n_base counts all places of base phrases, overlaps
    included, first_word and last_word are their smallest and largest start. labels adds those of
    notices (label, words) found by voting, n_spans counts their spans, score is the largest share of
    a template's grams seen in a verified span. Notices may be of any length. Repeated rows are
    scanned each; a very long text is one array of words; other columns are ignored; an empty df
    gives no rows.

    Every k neighbouring words are hashed and joined to the fixed list of template positions, in the
    same stage as the scan. A hit votes for the diagonal word - position; a row past the last word
    carries the document itself through the join. Only hits are shuffled. A base phrase needs all
    votes on its diagonal. For a notice, diagonals up to DRIFT apart are merged around a local
    maximum, and the span is verified on the words themselves: hits compare words, not hashes, and
    the merged diagonals must show COVER of the template's distinct positions. On diagonals so near,
    positions more than 2 DRIFT apart follow in the template's order.
    """
    spark = df.sparkSession
    rows = _grams(notices, k)
    sizes = sorted({len(r[5]) for r in rows})
    templates = spark.createDataFrame(
        [*((*r, len(r[5])) for r in rows), (-1, "", False, 1, 0, [], 0)], "template int, label string, base boolean, grams int, spot int, gram array<string>, size int"
    )
    hashed = F.lit(0).cast("long")
    for n in sizes:
        hashed = F.when(F.col("size") == n, F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(n)])).otherwise(hashed)
    templates = templates.withColumn("hash", hashed)
    # Lower-casing other letters too changes no border of a word and makes no word of a base phrase.
    docs = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(_WORD), F.lit(0)).alias("words"),
    )
    each = docs.select("row", "doc_id", "words", F.posexplode(F.array_append("words", F.lit(""))).alias("at", "word"))
    after = [F.col("word"), *[F.get("words", F.col("at") + i) for i in range(1, max(sizes))]]
    own = [F.when(F.col("word") == "", F.lit(0).cast("long")).otherwise(F.xxhash64(*after[:n])) for n in sizes]
    each = each.withColumn("own", own[0] if len(own) == 1 else F.explode(F.array_distinct(F.array(*own))))
    same = F.lit(True)
    for i, word in enumerate(after):
        same = same & ((F.col("size") <= i) | word.eqNullSafe(F.get("gram", F.lit(i))))
    hits = each.join(F.broadcast(templates), F.col("own") == F.col("hash")).where((F.col("template") < 0) | same)
    votes = hits.groupBy("row", "doc_id", "template", "label", "base", "grams", (F.col("at") - F.col("spot")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.collect_set("spot").alias("seen")
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    back = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-DRIFT, -1)
    merged = votes.withColumn("top", F.max("votes").over(near)).withColumn("before", F.coalesce(F.max("votes").over(back), F.lit(0)))
    merged = merged.withColumn("wide", F.size(F.array_distinct(F.flatten(F.collect_list("seen").over(near)))) / F.col("grams"))
    place = F.col("base") & (F.col("votes") == F.col("grams"))
    peak = (F.col("votes") == F.col("top")) & (F.col("votes") > F.col("before"))
    span = ~F.col("base") & (F.col("template") >= 0) & peak & (F.col("wide") >= COVER)
    found = merged.withColumns({"place": place, "span": span})
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.max(F.when(F.col("template") < 0, F.col("diagonal"))).cast("long").alias("n_words"),
            F.count(F.when(F.col("place"), 1)).alias("n_base"),
            F.min(F.when(F.col("place"), F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("place"), F.col("diagonal"))).cast("long").alias("last_word"),
            joined(F.col("place")).alias("base_labels"),
            joined(F.col("place") | F.col("span")).alias("labels"),
            F.max(F.when(F.col("place"), 1.0).when(F.col("span"), F.col("wide")).otherwise(0.0)).alias("score"),
            F.count(F.when(F.col("span"), 1)).alias("n_spans"),
        )
        .drop("row")
    )


def _values() -> str:
    quote = lambda s: "'" + s + "'"
    return ",\n  ".join(f"({t}, {quote(label)}, {str(base).lower()}, {n}, {j}, {quote(a)}, {quote(b)})" for t, label, base, n, j, (a, b) in _grams(NOTICES, 2))


ORACLE_SQL = rf"""
WITH templates(template, label, base, pairs, spot, word_1, word_2) AS (VALUES
  {_values()}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
e AS (SELECT rid, words, unnest(range(len(words) - 1)) AS idx FROM d),
v AS (
  SELECT rid, template, label, base, pairs, idx - spot AS diagonal, count(*) AS votes, list(DISTINCT spot) AS seen
  FROM e JOIN templates ON words[idx + 1] = word_1 AND words[idx + 2] = word_2 GROUP BY ALL),
m AS (
  SELECT *, len(list_distinct(flatten(list(seen) OVER near))) / pairs AS wide, max(votes) OVER near AS top,
         coalesce(max(votes) OVER (PARTITION BY rid, template ORDER BY diagonal RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS before
  FROM v WINDOW near AS (PARTITION BY rid, template ORDER BY diagonal RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
f AS (
  SELECT *, base AND votes = pairs AS place, NOT base AND votes = top AND votes > before AND wide >= 0.8 AS span FROM m),
g AS (
  SELECT rid, count(*) FILTER (place) AS n_base, min(diagonal) FILTER (place) AS first_word, max(diagonal) FILTER (place) AS last_word,
         list(DISTINCT label) FILTER (place) AS base_labels, list(DISTINCT label) FILTER (place OR span) AS labels,
         max(CASE WHEN place THEN 1.0::DOUBLE WHEN span THEN wide::DOUBLE ELSE 0.0::DOUBLE END) AS score, count(*) FILTER (span) AS n_spans
  FROM f GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(labels), ','), '') AS labels, coalesce(score, 0.0::DOUBLE) AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN g USING (rid)
"""
