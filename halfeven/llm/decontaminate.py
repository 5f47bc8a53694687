"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Every run of ten consecutive words of a benchmark item is a window; an item with fewer words is one
window as a whole.  The windows go into a broadcast hash table and every window of every training
text is looked up in it.  The key is the window's words, not a digest, so a match is verified as it
is found.  The bytes of the windows and their item_ids are counted first: beyond `MAX_BROADCAST` the same
join runs as a shuffle.  A text makes its windows in blocks of `BLOCK` words, so a row holds a bounded
number of them however long the text is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, words

WINDOW = 10
#: At most this many bytes of windows and item_ids are broadcast.
MAX_BROADCAST = 64 << 20
#: What a window or an item_id takes in a broadcast table besides its characters, at most.
ENTRY = 64
#: Words of a document whose windows are in one row.
BLOCK = 2048


def _windows(w, at, n: int, block: int):
    """Array of (pos, len, ngram): every run of n consecutive words that starts among the first `block` of the array w."""
    run = lambda i: F.struct((at + i).alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(w, i + 1, F.lit(n)), " ").alias("ngram"))
    empty = F.array().cast("array<struct<pos:int,len:int,ngram:string>>")
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.least(F.size(w) - n, F.lit(block - 1))), run)).otherwise(empty)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of the items: ngram, len, items (their item_ids).  Items without words have none."""
    w = F.col("w")
    run = lambda i: F.array_join(F.slice(w, i + 1, F.lit(window)), " ")
    grams = F.when(F.size(w) >= window, F.transform(F.sequence(F.lit(0), F.size(w) - window), run)).otherwise(F.array(F.array_join(w, " ")))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", F.explode(grams).alias("ngram"), F.least(F.size("w"), F.lit(window)).alias("len"))
        .groupBy("ngram", "len")
        .agg(F.collect_set("item_id").alias("items"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged hit runs of words), text_key.

    A word inside any occurrence of a window is hit.  Null or wordless text has no words and no hits; an empty
    benchmark hits nothing.  Repeated rows and null ids each give a row of their own.  text_key is the text's SHA-256.
    An empty `docs` gives no rows.  A long text is one row of words; its windows leave that row block by block in the
    task that reads it.  Columns besides doc_id and text (item_id and text) are ignored, whatever their names.
    """
    grams = benchmark_windows(benchmark, window)
    held = ENTRY + F.octet_length("ngram") + F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + F.octet_length(i) + ENTRY)
    facts = grams.groupBy("len").agg(F.sum(held).alias("held")).collect()  # at most `window` rows
    if sum(r["held"] for r in facts) <= max_broadcast:
        grams = F.broadcast(grams)
    read = docs.select(F.col("doc_id").alias("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_key"), words(F.col("text")).alias("w"))
    longest = max((r["len"] for r in facts), default=1)
    cut = lambda at: F.struct(at.alias("at"), F.slice(F.col("w"), at + 1, F.lit(block + longest - 1)).alias("w"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(block)), cut)
    # one row more stands for the document itself: it has length 0 and a key that no window has, another one for each document
    name = F.concat_ws(" ", F.lit(""), F.col("doc_id").cast("string"), F.col("text_key"))
    own = F.when(F.col("b.at") == 0, F.array(F.struct(F.col("n_words").alias("pos"), F.lit(0).alias("len"), name.alias("ngram"))))
    none = F.array().cast("array<struct<pos:int,len:int,ngram:string>>")
    scanned = F.concat(*[_windows(F.col("b.w"), F.col("b.at"), r["len"], block) for r in facts], own.otherwise(none))
    hits = (
        read.select("doc_id", "text_key", F.size("w").alias("n_words"), F.explode(blocks).alias("b"))
        .select("doc_id", "text_key", F.explode(scanned).alias("x"))
        .select("doc_id", "text_key", "x.pos", "x.len", "x.ngram")
        .join(grams, ["ngram", "len"], "left")
        .where(F.col("items").isNotNull() | (F.col("len") == 0))
        .select("doc_id", "text_key", "pos", "len", "items")
    )
    # rows with equal id and text have equal answers: they are one group, from which partial aggregation leaves one set a task
    by_doc = hits.groupBy("doc_id", "text_key").agg(
        F.count(F.when(F.col("len") == 0, 1)).alias("copies"),
        F.max(F.when(F.col("len") == 0, F.col("pos"))).alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("len") > 0, F.struct("pos", (F.col("pos") + F.col("len")).alias("end"))))).alias("places"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))
    step = lambda a, x: F.struct(
        (a["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["pos"], a["reach"]))).alias("hit"), F.greatest(a["reach"], x["end"]).alias("reach")
    )
    found = by_doc.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("places", start, step)["hit"].cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
        F.col("places").alias("spans"),
        "text_key",
        F.sequence(F.lit(1).cast("long"), F.col("copies")).alias("copies"),
    )
    return found.withColumn("copies", F.explode("copies")).drop("copies")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a benchmark window, its columns as they were.

    The verdict depends on the text alone, so the join is by the text's digest: repeated and null ids need no care.
    """
    (key,) = fresh(docs, "x_text_key")
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("text_key").alias(key)).distinct()
    marked = docs.withColumn(key, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return marked.join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_decontaminate(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS ngram FROM (SELECT *, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS ngram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, x.n FROM x JOIN g ON x.ngram = g.ngram AND x.n = g.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
