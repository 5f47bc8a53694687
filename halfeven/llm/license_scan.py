"""License scan by diagonal voting.

Every rolling two-word gram of every text is joined, by hash, to the places where it stands in the
license templates.  A match at word p of the text and word t of the template votes for diagonal
p - t; votes are counted per diagonal, and neighbouring diagonals (a word added or left out) are merged.
A merged span begins at a diagonal and takes those at most `drift` beyond it, so single grams that stand
far apart never add up; it is verified by the share of its template's grams that stand inside it, each
within `drift` words of its place.  The words themselves are compared in the join, so a hash collision
cannot vote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, words

# The base phrases with their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Templates of the method's own; they add labels.
EXTRA = [
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("the software is provided as is without warranty of any kind", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("lesser general public license", "lgpl"),
    ("creative commons attribution", "cc-by"),
    ("released into the public domain", "public-domain"),
]
#: Words that may be added or left out in a span: its diagonals are at most this far apart.
DRIFT = 2
#: Share of a template's grams that must vote for a merged span.
ENOUGH = 0.7


def template_rows(templates: list[tuple[str, str]]) -> list[tuple]:
    """(template, tpos, w1, w2) for every two-word gram; template -1 is the row that each document matches once."""
    rows = [(-1, 0, "", None)]
    for k, (phrase, _) in enumerate(templates):
        w = phrase.split(" ")
        if not 2 <= len(w) <= 64:
            raise ValueError(f"a template has 2 to 64 words, not {len(w)}: {phrase}")
        rows += [(k, t, w[t], w[t + 1]) for t in range(len(w) - 1)]
    return rows


def license_spans(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """Votes by diagonal: row_id, doc_id, template, diagonal, votes (a bit for each of the template's grams, 63 at most).  Template -1 has the number of words as its diagonal.

    The template table is a fixed list of phrases (a few dozen rows), so broadcasting it is safe at any input size.
    Rows are dealt by row_id, which is one per document: no key is hot.
    """
    spark = docs.sparkSession
    key = lambda w1, w2: F.when(w1 == "", F.lit(0).cast("long")).otherwise(F.xxhash64(w1, w2))
    places = spark.createDataFrame(template_rows(templates), "template int, tpos int, t1 string, t2 string")
    places = places.withColumn("key", key(F.col("t1"), F.col("t2")))
    read = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").alias("doc_id"), words(F.col("text")).alias("w"))
    # the last gram has no second word and matches nothing; the row after it stands for the document itself
    last = F.array(F.struct(F.lit("").alias("w1"), F.lit(None).cast("string").alias("w2")))
    zipped = F.arrays_zip(F.col("w").alias("w1"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("w2"))
    grams = read.select("row_id", "doc_id", F.posexplode(F.concat(zipped.cast("array<struct<w1:string,w2:string>>"), last)).alias("pos", "g")).select(
        "row_id", "doc_id", "pos", F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2")
    )
    hits = grams.withColumn("gram", key(F.col("w1"), F.col("w2"))).join(
        F.broadcast(places), (F.col("gram") == F.col("key")) & (F.col("w1") == F.col("t1")) & F.col("w2").eqNullSafe(F.col("t2"))
    )
    return (
        hits.select("row_id", "doc_id", "template", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .repartition("row_id")
        .groupBy("row_id", "doc_id", "template", "diagonal")
        .agg(F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("votes"))
    )


def license_scan(docs: DataFrame, base=BASE, extra=EXTRA, drift: int = DRIFT, enough: float = ENOUGH) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases (a diagonal with all its votes); first_word and last_word are their
    smallest and largest start, null without any.  score is the best share of a template's grams in one merged span.
    Null or wordless text: 0 words, no labels, score 0.  Repeated rows and null ids each give a row of their own.  A long
    text is one row of words; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark, templates = docs.sparkSession, [*base, *extra]
    facts = spark.createDataFrame(
        [(k, len(p.split(" ")) - 1, label, k < len(base)) for k, (p, label) in enumerate(templates)], "template int, grams int, label string, is_base boolean"
    )
    votes = license_spans(docs, templates).join(F.broadcast(facts), "template", "left")
    span = Window.partitionBy("row_id", "template").orderBy("diagonal").rangeBetween(0, drift)
    merged = votes.withColumn("span_votes", F.bit_count(F.bit_or("votes").over(span)))
    whole = F.col("is_base") & (F.bit_count("votes") == F.col("grams"))
    share = F.when(F.col("template") >= 0, F.least(F.lit(1.0), F.col("span_votes") / F.col("grams")))
    found = whole | (~F.col("is_base") & (share >= enough))
    join = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return merged.groupBy("row_id", "doc_id").agg(
        F.max(F.when(F.col("template") == -1, F.col("diagonal"))).cast("long").alias("n_words"),
        F.sum(F.when(whole, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(whole, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).cast("long").alias("last_word"),
        join(F.when(whole, F.col("label"))).alias("base_labels"),
        join(F.when(found, F.col("label"))).alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
    ).drop("row_id")


def op5_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def oracle(base=BASE, extra=EXTRA, drift: int = DRIFT, enough: float = ENOUGH) -> str:
    templates = [*base, *extra]
    grams = ", ".join(f"({k}, {t}, '{a}', '{b}')" for k, t, a, b in template_rows(templates)[1:])
    facts = ", ".join(f"({k}, {len(p.split(' ')) - 1}, '{label}', {k < len(base)})" for k, (p, label) in enumerate(templates))
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w),
t(template, tpos, t1, t2) AS (VALUES {grams}),
f(template, grams, label, is_base) AS (VALUES {facts}),
v AS (SELECT doc_id, template, i - 1 - tpos AS diagonal, bit_or(1::BIGINT << tpos) AS votes FROM g JOIN t ON w[i] = t1 AND w[i + 1] = t2 GROUP BY ALL),
s AS (SELECT v.*, grams, label, is_base, is_base AND bit_count(votes) = grams AS whole,
             least(1.0::DOUBLE, bit_count(bit_or(votes) OVER (PARTITION BY doc_id, v.template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {drift} FOLLOWING))::DOUBLE / grams) AS share FROM v JOIN f USING (template)),
a AS (SELECT doc_id, count(*) FILTER (whole) AS n_base, min(diagonal) FILTER (whole) AS first_word, max(diagonal) FILTER (whole) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole OR (NOT is_base AND share >= {enough})) AS labels, max(share) AS score FROM s GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN a USING (doc_id)
"""
