"""Exact deduplication with a heavy-hitter split.

One pass takes the SHA-256 of every normalised text.  A Misra-Gries style summary
(`approx_top_k`, a frequent-items sketch with a fixed number of counters) names every digest
that can hold more than 1 / counters of the rows; an exact count verifies those candidates.
The verified winners, at most `counters` rows, are broadcast and settle their rows on the map
side, so a text that a third of all rows share never meets in one task.  All other digests,
each below 1 / counters of the rows, take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, materialise

#: Counters of the summary: a digest with more than 1/4096 of the rows cannot be missed.
COUNTERS = 4096


def normalised(text):
    return ascii_lower(F.coalesce(text, F.lit("")))


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Winners among `digests` (columns digest, doc_id, row_id): digest, keep (doc_id, row_id), group_size.

    At most `counters` rows: those that the summary holds and that are counted, exactly, twice or more.
    """
    listed = digests.agg(F.expr(f"approx_top_k(digest, {counters}, {counters})").alias("top"))
    candidates = listed.select(F.explode("top.item").alias("digest")).distinct()
    return (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty text.  Of equal
    texts the row with the largest doc_id is kept (null ids sort first; of rows with one id, exactly
    one stays).  An empty table gives no rows; other columns are ignored.
    """
    digests = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(normalised(F.col("text")), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "digests",
    )
    winners = materialise(heavy_digests(digests, counters), "winners")
    split = digests.join(F.broadcast(winners), "digest", "left")
    heavy = split.where("group_size is not null")
    group = Window.partitionBy("digest")
    light = (
        split.where("group_size is null")
        .select("doc_id", "digest", "row_id")
        .withColumn("keep", F.max(F.struct("doc_id", "row_id")).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return heavy.select(*light.columns).unionByName(light).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("keep.row_id") == F.col("row_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """`docs` with one row of each group of equal texts, its columns as they were.

    Rows of a heavy digest that are not its winner go before the shuffle.  All others are aggregated by digest, on the
    map side first, so what a task gets of a digest is one row of each map task at most.  The row with the largest doc_id
    stays (null ids sort first); of rows that also share the id, the one whose text sorts last.  Null counts as empty
    text, an empty table stays empty, and other columns may have any names and nulls.
    """
    digest, row, heavy, kept = fresh(docs, "x_digest", "x_row", "x_heavy", "x_kept")
    slim = materialise(
        docs.select(F.col("doc_id").alias("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("digest"), F.lit(0).alias("row_id")), "digests"
    )
    winners = materialise(heavy_digests(slim, counters).select(F.col("digest").alias(digest), F.col("keep.doc_id").alias(heavy)), "winners")
    marked = docs.withColumn(digest, F.sha2(normalised(F.col("text")), 256))
    left = marked.join(F.broadcast(winners.withColumn(row, F.lit(True))), digest, "left").where(
        F.col(row).isNull() | F.col("doc_id").eqNullSafe(F.col(heavy))
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("c"))
    return left.groupBy(digest).agg(F.max_by(F.struct(*columns), order).alias(kept)).select(*[F.col(f"{kept}.`{c}`").alias(c) for c in docs.columns])


def op4_exact_dedup(spark, sf_dir):
    from .common import table

    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""
