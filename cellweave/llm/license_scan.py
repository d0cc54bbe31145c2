"""License scans by diagonal voting over word k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, let, lower_ascii, text_of

K = 2
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: phrase -> label, found at every place where the words stand consecutively.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: label -> notices, found where most of their words stand in order with few words put in, left out or changed.
NOTICES = {
    "apache-2.0": ("licensed under the apache license version 2 0",),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "released under the mit license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "cc": ("licensed under a creative commons attribution license", "this work is licensed under a creative commons attribution 4 0 international license"),
    "public-domain": ("this work has been dedicated to the public domain", "this is free and unencumbered software released into the public domain"),
    "copyright": ("no part of this publication may be reproduced without the prior written permission of the publisher",),
}
#: A notice counts where this share of its word pairs is found ...
LEAST_SHARE = 0.75
#: ... on diagonals that lie this close together.
SHIFT = 3
#: A group of diagonals: the smallest and largest, the smallest and largest place of a hit, and the template's positions hit.
GROUP = ("first", "last", "low", "high", "hits")


def templates() -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, exact, pairs, position, word pair) for each position of each phrase and notice."""
    every = [(p, label, True) for p, label in PHRASES.items()] + [(n, label, False) for label, notices in NOTICES.items() for n in notices]
    out = []
    for number, (phrase, label, exact) in enumerate(every):
        w = phrase.split()
        out += [(number, label, exact, len(w) - K + 1, i, " ".join(w[i : i + K])) for i in range(len(w) - K + 1)]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Every pair of neighbouring words of every text is joined on its hash with
    the templates' positions (a fixed table, so it is broadcast) and verified
    word by word.  A hit votes for the diagonal (place in the text minus place
    in the template).  A phrase is found on each diagonal that has all its
    pairs.  Diagonals of a notice that lie within ``SHIFT`` of the next one and
    whose hits are less than the notice's length apart are merged; the span is
    verified by the share of the template's positions hit, ``LEAST_SHARE`` at least.
    spans has (label, first word, words) of each find.  score is the largest share.

    A row's hits meet under its number in the scan, so repeated and null
    doc_ids stay apart.  Null or empty text: no words, no labels, score 0.
    Empty table: empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    fixed = spark.createDataFrame(templates(), "template int, label string, exact boolean, pairs int, tpos int, gram string")
    fixed = fixed.withColumn("h", F.xxhash64("gram"))
    w = F.array_remove(F.split(lower_ascii(text_of(docs)), SPLIT), "")
    # The words' pairs, and at last the number of words, so that each row of docs comes out once at least.
    grams = let(w, lambda w: F.concat(F.when(F.size(w) < K, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))), F.array(F.size(w).cast("string"))))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.monotonically_increasing_id().alias("rid"), grams.alias("_g"))
    pairs = rows.select("doc_id", "rid", F.posexplode("_g").alias("pos", "gram"))
    # A count has no blank, a pair has one.
    marked = pairs.withColumn("is_count", ~F.col("gram").contains(" ")).withColumn("h", F.xxhash64("gram"))
    hit = (marked["h"] == fixed["h"]) & (marked["gram"] == fixed["gram"])
    hits = marked.join(F.broadcast(fixed), hit, "left").where("is_count OR template IS NOT NULL").select("rid", "doc_id", "pos", "is_count", marked["gram"].alias("gram"), "template", "label", "exact", "pairs", "tpos")
    votes = hits.groupBy("rid", "doc_id", "template").agg(
        F.max(F.when(F.col("is_count"), F.col("gram").cast("bigint"))).alias("n_words"),
        F.first("label", ignorenulls=True).alias("label"),
        F.first("exact", ignorenulls=True).alias("exact"),
        F.first("pairs", ignorenulls=True).alias("pairs"),
        F.array_sort(F.collect_list(F.when(~F.col("is_count"), F.struct((F.col("pos") - F.col("tpos")).alias("diagonal"), F.col("tpos"))))).alias("votes"),
    )
    return _found(votes)


def _found(votes: DataFrame) -> DataFrame:
    """Diagonals of each row and template merged and verified, then the row's finds together."""
    n = F.size("votes")

    def walk(group: Column, i: Column) -> Column:
        """One vote further, and at last none: the group it joins or opens, and the group that it closes."""

        def step(v: Column) -> Column:
            near = ~F.col("exact") & (v["diagonal"] - group["last"] <= SHIFT) & (v["diagonal"] - group["first"] < F.col("pairs"))
            joins = F.coalesce((F.size(group["hits"]) > 0) & ((v["diagonal"] == group["last"]) | near), F.lit(False))
            at, tpos = F.coalesce(v["diagonal"], F.lit(0)), F.coalesce(v["tpos"], F.lit(0))
            hits = F.when(F.array_contains(group["hits"], tpos), group["hits"]).otherwise(F.concat(group["hits"], F.array(tpos)))
            grown = [group["first"], at, F.least(group["low"], at + tpos), F.greatest(group["high"], at + tpos), hits]
            fresh = [at, at, at + tpos, at + tpos, F.array(tpos)]
            state = lambda values: F.struct(*[x.alias(name) for name, x in zip(GROUP, values, strict=True)])
            share = F.size(group["hits"]) / F.col("pairs")
            closed = F.struct(group["low"].cast("bigint").alias("low"), group["high"].cast("bigint").alias("high"), share.alias("share"))
            out = F.when(~joins & (F.size(group["hits"]) > 0), closed)
            return F.struct(F.when(joins, state(grown)).otherwise(state(fresh)).alias("state"), out.alias("out"))

        return let(F.get(F.col("votes"), i), step)

    none = F.expr("named_struct('first', 0, 'last', 0, 'low', 0, 'high', 0, 'hits', cast(array() as array<int>))")
    groups = F.array_compact(in_blocks(n + 1, none, "struct<low: bigint, high: bigint, share: double>", walk))
    good = F.filter("groups", lambda g: F.when(F.col("exact"), g["share"] >= 1.0).otherwise(g["share"] >= LEAST_SHARE))
    kept = votes.withColumn("groups", F.when(F.col("label").isNotNull(), groups)).withColumn("good", good)
    spans = F.transform("good", lambda g: F.struct(F.col("label").alias("label"), g["low"].alias("first"), (g["high"] - g["low"] + K).alias("words")))
    per = kept.select(
        "rid", "doc_id", "n_words",
        F.when(F.size("good") > 0, F.col("label")).alias("label"),
        F.when(F.col("exact") & (F.size("good") > 0), F.col("label")).alias("base_label"),
        F.when(F.col("exact"), F.transform("good", lambda g: g["low"])).alias("places"), spans.alias("spans"),
        F.array_max(F.transform("groups", lambda g: F.when(~F.col("exact") | (g["share"] >= 1.0), g["share"]))).alias("share"),
    )
    rows = per.groupBy("rid", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("places")).alias("_places"),
        F.concat_ws(",", F.array_sort(F.collect_set("base_label"))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    return rows.select("doc_id", "n_words", F.size("_places").cast("bigint").alias("n_base"), F.array_min("_places").alias("first_word"), F.array_max("_places").alias("last_word"), "base_labels", "labels", "score", "spans")


def _values() -> str:
    return ", ".join(f"({t}, '{label}', {str(exact).lower()}, {pairs}, {i}, '{gram}')" for t, label, exact, pairs, i, gram in templates())


#: The same in DuckDB.  A new group of diagonals begins where the gap or the whole extent is too large; the running rule needs recursion over a row's votes.
ORACLE_SQL = f"""
WITH RECURSIVE fixed(template, label, exact, pairs, tpos, gram) AS (VALUES {_values()}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT rid, unnest(list_transform(range(1, len(w)), lambda i: {{'pos': i - 1, 'gram': w[i] || ' ' || w[i + 1]}})) AS u FROM d
), hits AS (
  SELECT rid, template, label, exact, pairs, u.pos - tpos AS diagonal, tpos,
         row_number() OVER (PARTITION BY rid, template ORDER BY u.pos - tpos, tpos) AS k
  FROM g JOIN fixed ON u.gram = fixed.gram
), walk AS (
  SELECT *, diagonal AS first, 1 AS grp FROM hits WHERE k = 1
  UNION ALL
  SELECT h.*, CASE WHEN h.diagonal = w.diagonal OR (NOT h.exact AND h.diagonal - w.diagonal <= {SHIFT} AND h.diagonal - w.first < h.pairs) THEN w.first ELSE h.diagonal END,
         CASE WHEN h.diagonal = w.diagonal OR (NOT h.exact AND h.diagonal - w.diagonal <= {SHIFT} AND h.diagonal - w.first < h.pairs) THEN w.grp ELSE w.grp + 1 END
  FROM walk w JOIN hits h ON h.rid = w.rid AND h.template = w.template AND h.k = w.k + 1
), groups AS (
  SELECT rid, template, label, exact, first, max(diagonal) AS last, min(tpos) AS low, max(tpos) AS high,
         count(DISTINCT tpos) / any_value(pairs) AS share
  FROM walk GROUP BY rid, template, label, exact, first, grp
), good AS (SELECT * FROM groups WHERE share >= CASE WHEN exact THEN 1.0 ELSE {LEAST_SHARE} END),
agg AS (
  SELECT rid, count(*) FILTER (exact) AS n_base, min(first) FILTER (exact) AS first_word, max(first) FILTER (exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM good GROUP BY rid
), best AS (SELECT rid, max(share) AS score FROM groups WHERE NOT exact OR share >= 1.0 GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN agg USING (rid) LEFT JOIN best USING (rid)
"""
