"""Operator 2: license scans by diagonal voting, in DataFrame functions alone.

All rolling word k-grams of all texts are joined by hash to the positions of the notices
below (a table of fixed size, so it is broadcast). A match votes for the diagonal "place
in the text minus place in the notice"; votes are summed by diagonal, diagonals at most
MAX_GAP apart are merged, and a merged span counts if the words that its votes verify,
one by one, cover MIN_COVER of the notice. Phrases of the base are notices that one gram
covers whole.

Defined results. Null or empty text: no words, no labels, score 0. Null or repeated
doc_ids: a row for each row. Very long texts are scanned whole. Notices that overlap all
count. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Words of a gram. Notices of fewer words are one shorter gram.
K = 3
MAX_GAP = 2
MIN_COVER = 0.8
#: The phrases of the base and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wording of well-known notices, label first.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
]
#: Stands for the end of a text, so that texts without a match keep a row.
_END = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of a text's words: A-Z in lower case, runs of digits, letters and all beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _python_words(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def notice_grams(spark: SparkSession, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """Grams of base phrases and notices: notice, label, is_base, n_words, at, w1, w2, w3."""
    rows = [(-1, "", False, 0, 0, _END, None, None)]
    sources = [(label, phrase, True) for phrase, label in BASE.items()]
    sources += [(label, text, False) for label, text in (NOTICES if notices is None else notices)]
    for number, (label, text, is_base) in enumerate(sources):
        own = _python_words(text)
        size = min(K, len(own))
        for at in range(len(own) - size + 1):
            gram = own[at : at + size] + [None] * (K - size)
            rows.append((number, label, is_base, len(own), at, *gram))
    return spark.createDataFrame(rows, "notice int, label string, is_base boolean, notice_words int, at int, t1 string, t2 string, t3 string")


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score and spans (array of label, start, end in words, cover) of all notices."""
    w = words(F.col("text"))
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.concat(w, F.array(F.lit(_END))).alias("w"))
    n = F.size("w")
    shifted = [F.col("w").alias("w1"), F.slice("w", 2, n).alias("w2"), F.slice("w", 3, n).alias("w3")]
    grams = own.select("doc_id", "rid", F.arrays_zip(*shifted).alias("z")).select("doc_id", "rid", F.posexplode("z").alias("pos", "g")).select("doc_id", "rid", "pos", "g.w1", "g.w2", "g.w3")
    known = notice_grams(docs.sparkSession, notices)
    same = F.xxhash64("w1", F.when(F.col("w1") != _END, F.col("w2"))) == F.xxhash64("t1", "t2")
    verified = (F.col("w1") == F.col("t1")) & (F.col("t2").isNull() | (F.col("t2") == F.col("w2"))) & (F.col("t3").isNull() | (F.col("t3") == F.col("w3")))
    votes = grams.join(F.broadcast(known), same & verified).select("doc_id", "rid", "notice", "label", "is_base", "notice_words", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    # one exchange, by text; everything below stays within its partitions
    diagonals = votes.repartition("rid").groupBy("doc_id", "rid", "notice", "label", "is_base", "notice_words", "diagonal").agg(F.collect_set("at").alias("ats"))
    line = Window.partitionBy("rid", "notice").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > F.when(F.col("is_base"), 0).otherwise(MAX_GAP), F.lit(True))
    merged = diagonals.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(line)).groupBy("doc_id", "rid", "notice", "label", "is_base", "notice_words", "span").agg(
        F.flatten(F.collect_list("ats")).alias("ats"), F.min(F.col("diagonal") + F.array_min("ats")).alias("start"), F.max(F.col("diagonal") + F.array_max("ats")).alias("end")
    )
    size = F.least(F.lit(K), F.col("notice_words"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda p: F.sequence(p, p + size - 1)))))
    spans = merged.withColumn("cover", F.when(F.col("notice") >= 0, covered / F.col("notice_words")).otherwise(0.0)).withColumn("end", F.col("end") + size)
    is_end, is_base, is_hit = F.col("notice") < 0, F.col("is_base"), (F.col("notice") >= 0) & (F.col("cover") >= MIN_COVER)
    joined = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(F.when(c, F.col("label")))))
    return spans.groupBy("rid", "doc_id").agg(
        F.max(F.when(is_end, F.col("start"))).cast("long").alias("n_words"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        joined(is_base).alias("base_labels"),
        joined(is_base | is_hit).alias("labels"),
        F.max("cover").alias("score"),
        F.sort_array(F.collect_list(F.when(is_base | is_hit, F.struct("start", "end", "label", "cover")))).alias("spans"),
    ).drop("rid")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_sql() -> str:
    """The same in SQL, over the same notices."""
    rows, sources = [], [(label, phrase, True) for phrase, label in BASE.items()] + [(label, text, False) for label, text in NOTICES]
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    for number, (label, text, is_base) in enumerate(sources):
        own = _python_words(text)
        size = min(K, len(own))
        rows += [f"({number}, '{label}', {is_base}, {len(own)}, {size}, {at}, {', '.join(map(quoted, own[at : at + size] + [None] * (K - size)))})" for at in range(len(own) - size + 1)]
    return f"""
WITH known(notice, label, is_base, nw, size, place, t1, t2, t3) AS (VALUES {', '.join(rows)}),
tok AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT rid, i - 1 AS pos, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM tok)),
votes AS (SELECT DISTINCT rid, notice, label, is_base, nw, size, place, pos - place AS d FROM grams JOIN known ON w1 = t1 AND (t2 IS NULL OR t2 = w2) AND (t3 IS NULL OR t3 = w3)),
lines AS (SELECT *, d - lag(d) OVER (PARTITION BY rid, notice ORDER BY d) AS gap FROM (SELECT DISTINCT rid, notice, is_base, d FROM votes)),
runs AS (SELECT rid, notice, d, sum(CASE WHEN gap IS NULL OR gap > CASE WHEN is_base THEN 0 ELSE {MAX_GAP} END THEN 1 ELSE 0 END) OVER (PARTITION BY rid, notice ORDER BY d) AS run FROM lines),
places AS (SELECT v.*, run FROM votes v JOIN runs USING (rid, notice, d)),
words AS (SELECT DISTINCT rid, notice, run, unnest(range(place, place + size)) AS p FROM places),
covers AS (SELECT rid, notice, run, count(*) AS n FROM words GROUP BY ALL),
spans AS (SELECT rid, notice, run, label, is_base, n / nw AS cover, min(d + place) AS start FROM places JOIN covers USING (rid, notice, run) GROUP BY ALL),
found AS (SELECT rid, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word, max(cover) AS score,
  list_sort(list_distinct(list(label) FILTER (is_base))) AS b, list_sort(list_distinct(list(label) FILTER (is_base OR cover >= {MIN_COVER}))) AS l FROM spans GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0.0) AS score FROM tok LEFT JOIN found USING (rid)
"""
