r"""Secret scan with an incremental blob ledger.

Every version of every text is addressed by its content (SHA-256).  A blob is scanned once per rule
version: pairs that the ledger already holds are skipped, and of equal texts only one row is scanned.
Findings, kept in the ledger by blob, are then joined back to every path (here: document) that has it.

Positions come from splitting a text at a pattern: the lengths of the pieces and of the matches,
summed in order, give each match's start in code points.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget_at_exit, materialise, scratch_path, table


@dataclass(frozen=True)
class Rule:
    """kind; Java pattern; the group whose length counts and its least length; literals of which a text needs one, lower case."""

    kind: str
    pattern: str
    group: int
    least: int
    needs: tuple[str, ...] = ()


# The base kinds.  A dropped match of hex or access cannot hide a longer one (both take whole runs), so
# their patterns state the least length; assign's must not, since a short match uses up its text.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "api")),
    Rule("access", "(AKIA[A-Z0-9]{16,})", 1, 20, ("akia",)),
    Rule("hex", "([0-9a-f]{24,}+)", 1, 24),
)
#: Kinds of the method's own.
EXTRA = (
    Rule("pem", "(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", 1, 1, ("private key-----",)),
    Rule("github", "(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1, ("eyj",)),
)
RULES = BASE + EXTRA
#: Change this with any rule: every blob is then scanned again.
RULE_VERSION = "1"

LEDGER = "blob string, rule_version string, findings array<struct<start:bigint,rank:int,end:bigint>>"


def _matches(text: Column, folded: Column, rank: int, rule: Rule) -> Column:
    """struct(rank, parts): parts are (piece before the match, match, counted group); null without a match."""
    hint = F.lit(True)
    if rule.needs:
        hint = F.lit(False)
        for literal in rule.needs:
            hint = hint | folded.contains(literal)
    p = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("piece"), F.regexp_extract_all(text, p, F.lit(0)).alias("match"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("counted")
    )
    lengths = F.transform(parts, lambda x: F.struct(F.char_length(x["piece"]).alias("piece"), F.char_length(x["match"]).alias("match"), F.char_length(x["counted"]).alias("counted")))
    return F.when(hint & text.rlike(rule.pattern), F.struct(F.lit(rank).alias("rank"), F.lit(rule.least).alias("least"), lengths.alias("parts")))


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, findings (start, rank of the kind, end; ordered) of `blobs` (blob, text); blobs without any are left out."""
    text, folded = F.col("text"), F.lower(F.col("text"))
    kinds = F.filter(F.array(*[_matches(text, folded, k, r) for k, r in enumerate(rules)]), lambda x: x.isNotNull())
    parts = blobs.select("blob", F.explode(kinds).alias("m")).select("blob", "m.rank", "m.least", F.posexplode("m.parts").alias("at", "x"))
    before = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("end", F.sum(F.col("x.piece").cast("long") + F.coalesce(F.col("x.match"), F.lit(0))).over(before))
    return (
        placed.where(F.col("x.counted") >= F.col("least"))
        .select("blob", F.struct((F.col("end") - F.col("x.match")).alias("start"), "rank", "end").alias("f"))
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list("f")).alias("findings"))
    )


def address(docs: DataFrame) -> DataFrame:
    """doc_id and blob (SHA-256 of the text; null is the empty text) of every row."""
    return docs.select(F.col("doc_id").alias("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))


def update_ledger(docs: DataFrame, paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, findings) for the blobs of `docs` that `ledger` has not seen with this rule version.

    One text of each unseen blob is scanned, however often the blob repeats and whatever the ids of its rows.
    """
    unseen = paths.select("blob").distinct()
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    # copies go where they are read, so a hot text is shuffled once a task
    found = find(texts.dropDuplicates(["blob"]).join(unseen, "blob", "left_semi").select("blob", "text"), rules)
    return unseen.join(found, "blob", "left").select(
        "blob", F.lit(version).alias("rule_version"), F.coalesce("findings", F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")).alias("findings")
    )


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, findings) of every row of `docs`, and the ledger's new rows.

    Null text is the empty text and has no findings; repeated rows and null ids each give a row.  Documents with
    equal text share one scan.  An empty table gives no rows and no ledger rows; other columns are ignored, whatever their
    names; a long text is scanned as one.
    """
    paths = materialise(address(docs), "paths")
    new = materialise(update_ledger(docs, paths, ledger, rules, version), "ledger")
    known = new if ledger is None else new.unionByName(ledger.where(F.col("rule_version") == version))
    return paths.join(known.where(F.size("findings") > 0).select("blob", "findings"), "blob", "left").select("doc_id", "blob", "findings"), new


def stored_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a stored ledger, from the runs that were written to their end; None if there are none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []
    done = [r.toString() for r in runs if files.exists(hadoop(r, "_SUCCESS"))]
    return spark.read.schema(LEDGER).parquet(*done) if done else None


def scan_stored(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """(doc_id, blob, findings) of every row of `docs`, with a ledger stored in the shared folder `path`.

    Blobs that a finished run has scanned with this rule version are not scanned again; what is new is added as a run of
    its own, so a run that was broken off leaves nothing.  Runs at one time may add a blob twice, with equal findings.
    """
    spark = docs.sparkSession
    paths = materialise(address(docs), "paths")
    update_ledger(docs, paths, stored_ledger(spark, path), rules, version).hint("rebalance").write.parquet(f"{path}/run-{uuid.uuid4().hex}")
    known = stored_ledger(spark, path).where((F.col("rule_version") == version) & (F.size("findings") > 0))
    known = known.groupBy("blob").agg(F.first("findings").alias("findings"))
    return paths.join(known, "blob", "left").select("doc_id", "blob", "findings")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE)) -> DataFrame:
    """Counts and listed spans of each document's findings."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    listed = lambda a: F.array_join(F.transform(a, lambda f: F.concat_ws(":", F.get(kinds, f["rank"]), f["start"].cast("string"), f["end"].cast("string"))), ",")
    have = found.withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")))
    count = lambda k: F.size(F.filter("findings", lambda f: f["rank"] == k)).cast("long").alias(f"n_{rules[k].kind}")
    return have.select(
        "doc_id",
        *[count(k) for k in range(n_base)],
        F.sha2(listed(F.filter("findings", lambda f: f["rank"] < n_base)), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
    )


def op9_secret_scan(spark, sf_dir):
    ledger = forget_at_exit(spark, scratch_path(spark, "secret-ledger"))
    return digest(scan_stored(table(spark, sf_dir, "documents"), ledger))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same spans in DuckDB; its matches of a possessive run are those of a greedy one."""
    kinds = []
    for k, r in enumerate(rules):
        p = r.pattern.replace("}+", "}").replace("'", "''")
        kinds.append(
            f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {r.group}) AS g FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({" UNION ALL ".join(kinds)}),
x AS (SELECT doc_id, rank, kind, least, i, length(p[i]) AS before, length(m[i]) AS n, length(g[i]) AS counted FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
s AS (SELECT *, sum(before + n) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM x),
f AS (SELECT doc_id, rank, kind, (e - n)::BIGINT AS b, e::BIGINT AS e FROM s WHERE counted >= least),
a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
             string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
