"""Readers: Parquet to typed frames, and the shared folder for snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The decimal types of the test tables' DOUBLE columns, and the tables' keys.
DECIMALS = {
    "l_quantity": (12, 2), "l_extendedprice": (12, 2), "l_discount": (4, 2), "l_tax": (4, 2), "o_totalprice": (12, 2),
    "c_acctbal": (12, 2), "s_acctbal": (12, 2), "p_retailprice": (12, 2), "value": (12, 2),
}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def configured(spark: SparkSession) -> SparkSession:
    """Sets what the dialect relies on; the caller's session may have other settings."""
    for key, value in {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.timeType.enabled": "true", "spark.sql.adaptive.enabled": "true"}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def typed(df: DataFrame, decimals: dict[str, tuple[int, int]] = DECIMALS) -> DataFrame:
    """Columns in the dialect's types: integers as BIGINT, DOUBLE as the decimal that `decimals` names (else DECIMAL(18,6))."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("decimal({},{})".format(*decimals.get(f.name, (18, 6))))
        elif not isinstance(f.dataType, (T.LongType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)) and not f.dataType.simpleString().startswith("time("):
            continue  # arrays and the like have no type in the dialect
        out.append(c.alias(f.name))
    return df.select(*out)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return typed(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def snapshot_path(spark: SparkSession, label: str) -> str:
    """A new folder in the cluster's shared folder (spark.checkpoint.dir); a local session gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='halfeven-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
