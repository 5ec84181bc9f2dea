"""License scan in DataFrame operations only: phrases, and an exact set-similarity join.

**Phrases.**  Places where the words of a fixed phrase stand consecutively give base labels.

**Method.**  A text block is a run of consecutive words, whatever line ends are among them; every license
template is a set of words.  For a template of ``n`` words the blocks are all runs of ``n / CONTAINMENT``
words, so a notice that wraps or has words put in is compared as a whole.  A block meets a
template when it holds at least ``CONTAINMENT`` of its distinct words.  All such pairs are found by
a prefix-filtered join:

* words are ordered by how often all documents hold them, rare ones first;
* prefix filter: a block that meets a template holds one of its first ``size - needed + 1`` words.
  Texts without such a word are passed over; the others are cut into overlapping tiles, of
  which each block lies whole in one, and tiles are joined with templates on prefix words;
* length filter: a tile needs as many of the template's words as the overlap;
* positional filter: the first word that a tile shares with a template, at place i of the order,
  leaves ``size - i`` words, which must reach the overlap; the pair is kept at that word only;
* in the remaining pairs the overlap of every block is counted exactly.

**Scale.**  Texts are scanned three times and never shuffled; the join partner is the template
table, fixed and tiny.  Word counts are combined in each task before they move, and the driver
sees one count per vocabulary word.  Labels depend on the text alone and return to the rows by
a 128-bit key of the text, so copies of a text and repeated or null ids are no matter.

**Defined cases.**  Null text counts as empty: no words, no labels, score 0.  Every row is reported as often as it
occurs, whatever its id.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import KEY, materialize, text_key

CONTAINMENT = 0.8

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License notices as they are commonly written, normalised to words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl": "licensed under the gnu lesser general public license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-conditions": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "reserved": "copyright all rights reserved",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def spaced_words(text: Column) -> Column:
    """The words, each with one space before and after; one space if there are none."""
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), "^ | $", ""), F.lit(" "))


def _spaces(s: Column) -> Column:
    return (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """``docs(id, text)`` with the text's key to (id, key, n_words, n_base, first_word, last_word, base_labels array)."""
    phrases = PHRASES if phrases is None else phrases
    w = F.col("w")
    counted = docs.select("id", *KEY, spaced_words(F.col("text")).alias("w")).withColumn("n_words", F.when(w == "  ", F.lit(0)).otherwise(_spaces(w) - 1).cast("long"))
    n, first, last, labels = [], [], [], []
    for phrase, label in phrases.items():
        needle, there = f" {phrase} ", w.contains(f" {phrase} ")
        size = len(phrase.split())
        n.append(F.when(there, F.regexp_count(w, F.lit(f" {phrase}(?= )"))).otherwise(0))
        first.append(F.when(there, _spaces(F.substring_index(w, needle, 1))))
        last.append(F.when(there, F.col("n_words") - _spaces(F.substring_index(w, needle, -1)) - size))
        labels.append(F.when(there, F.lit(label)))
    total = n[0]
    for x in n[1:]:
        total = total + x
    return counted.select(
        "id", *KEY, "n_words", total.cast("long").alias("n_base"), F.array_min(F.array(*first)).alias("first_word"), F.array_max(F.array(*last)).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_labels"),
    )


def needed(size: int, containment: float) -> int:
    return max(1, math.ceil(containment * size - 1e-9))


def run_length(body: str, containment: float) -> int:
    """Words of the blocks that are compared with a template."""
    return math.ceil(len(body.split()) / containment - 1e-9)


def word_list(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ")


def template_matches(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """``docs(text)`` with its key to (key, label, overlap, containment): of each tile the best block, if it meets the template."""
    templates = TEMPLATES if templates is None else templates
    sets = {label: sorted(set(body.split())) for label, body in templates.items()}
    vocabulary = sorted(set().union(*sets.values()))
    words = word_list(F.col("text"))
    held = docs.select(F.explode(words).alias("t")).where(F.col("t").isin(vocabulary)).groupBy("t").agg(F.count("*").alias("n")).collect()
    counts = {r["t"]: r["n"] for r in held}
    order = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}
    rows = []
    for label, own in sorted(sets.items()):
        ranked, need = sorted(own, key=order.get), needed(len(own), containment)
        listed = ", ".join(f"'{t}'" for t in ranked)
        rows += [f"('{t}', '{label}', {i}, {len(ranked)}, {need}, {run_length(templates[label], containment)}, array({listed}))" for i, t in enumerate(ranked[: len(ranked) - need + 1]) if t in counts]
    if not rows:
        return docs.select(*KEY, F.lit("").alias("label"), F.lit(0).alias("overlap"), F.lit(0.0).alias("containment")).limit(0)
    prefix = docs.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(word, label, i, size, need, run, own)")
    first = F.array(*[F.lit(r.split("'")[1]) for r in dict.fromkeys(x.split(",")[0] for x in rows)])
    step = max(run_length(body, containment) for body in templates.values())
    # the words are bound by a lambda, so that they are split once and not for each tile
    cut = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(step)), lambda i: F.slice(w, i, 2 * step)))
    tiles = docs.where(F.arrays_overlap(words, first)).select(*KEY, F.explode(F.flatten(cut)).alias("tile"))
    shared = F.array_intersect("own", "tile")
    pairs = (
        tiles.select(*KEY, "tile", F.explode(F.array_intersect("tile", first)).alias("word"))
        .join(F.broadcast(prefix), "word")  # a row per word of a template's prefix
        .withColumn("shared", shared)
        .where((F.size("shared") >= F.col("need")) & (F.element_at("shared", 1) == F.col("word")) & (F.col("size") - F.col("i") >= F.col("need")))
    )
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tile") - F.col("run") + 1))
    most = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect("shared", F.slice("tile", i, F.col("run"))))))
    return pairs.select(*KEY, "label", "size", "need", most.alias("overlap")).where("overlap >= need").select(*KEY, "label", "overlap", (F.col("overlap") / F.col("size")).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *text_key(F.col(text_col)))
    found = template_matches(rows, templates, containment).groupBy(*KEY).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base = F.col("base_labels")
    return (
        phrase_places(rows)
        .join(materialize(found, "license-labels"), KEY, "left")
        .select(
            F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
            F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
            F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        )
    )


def oracle_sql() -> str:
    """Brute force in DuckDB: every run that starts with a template's word against that template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    at = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        test = " AND ".join(f"words[i + {j}] = '{p}'" for j, p in enumerate(parts))
        at.append(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM places WHERE {test}")
    values = ", ".join(f"('{label}', {sorted(set(body.split()))}, {needed(len(set(body.split())), CONTAINMENT)}, {run_length(body, CONTAINMENT)})" for label, body in TEMPLATES.items())
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({low}, '{word}') AS words FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM w),
base AS ({' UNION ALL '.join(at)}),
t AS (SELECT label, unnest(words) AS word, len(words) AS size, need, run FROM (VALUES {values}) AS v(label, words, need, run)),
hits AS (SELECT p.doc_id, p.i, t.* FROM (SELECT doc_id, i, words[i] AS word FROM places) p JOIN t ON p.word = t.word),
alive AS (SELECT doc_id, label FROM hits GROUP BY doc_id, label HAVING count(DISTINCT word) >= min(need)),
near AS (SELECT * FROM hits SEMI JOIN alive USING (doc_id, label)),
met AS (
  SELECT a.doc_id, a.label, count(DISTINCT b.word) * 1.0 / min(a.size) AS share
  FROM near a JOIN near b ON a.doc_id = b.doc_id AND a.label = b.label AND b.i >= a.i AND b.i < a.i + a.run
  GROUP BY a.doc_id, a.label, a.i HAVING count(DISTINCT b.word) >= min(a.need)
), b AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z FROM base GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM base GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id),
m AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(b.n, 0) AS n_base, b.a AS first_word, b.z AS last_word,
       coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(CAST(m.share AS DOUBLE), 0.0) END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN m USING (doc_id)
"""
