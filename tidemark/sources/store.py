"""Append-only partitioned storage with content digests, upserts and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PARTITION = ["asset_class", "dataset", "symbol", "granularity", "date"]


class ContractError(ValueError):
    """A table breaks its contract."""


def check(df: DataFrame, checks: dict[str, Column]) -> None:
    """All checks in one pass; each counts the rows that break it."""
    found = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items())).first().asDict()
    if broken := {k: v for k, v in found.items() if v}:
        raise ContractError(f"rows that break the contract: {broken}")


def digest(df: DataFrame, by: list[str]) -> DataFrame:
    """For each group a digest of its rows that doesn't depend on their order, and their number."""
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)))
    return df.groupBy(*by).agg(F.bit_xor(row).alias("digest"), F.sum(row.cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))


def append(df: DataFrame, path: str) -> int:
    """Writes the partitions that aren't there; a partition that is there must have the same content. Returns the number of new ones."""
    spark = df.sparkSession
    check(df, {"event before as-of": F.col("event_ts_ns") <= F.col("asof_ts_ns"), **{c: F.col(c).isNotNull() for c in PARTITION}})
    new = digest(df, PARTITION)
    try:
        old = digest(spark.read.schema(df.schema).parquet(path), PARTITION)
    except AnalysisException:
        old = None
    if old is not None:
        both = new.alias("a").join(old.alias("b"), PARTITION, "left")
        clash = both.where("b.n is not null and (a.digest <> b.digest or a.total <> b.total or a.n <> b.n)")
        if not clash.isEmpty():
            raise ContractError(f"partitions are immutable: {[r.asDict() for r in clash.select(*PARTITION).limit(5).collect()]}")
        df = df.join(old.select(*PARTITION), PARTITION, "left_anti").select(*df.columns)
        new = both.where("b.n is null")
    n = new.count()
    if n:
        df.repartition(*PARTITION).sortWithinPartitions(*PARTITION, "event_ts_ns").write.mode("append").option("compression", "zstd").partitionBy(*PARTITION).parquet(path)
    return n


def load(spark: SparkSession, path: str, schema, **partition: str) -> DataFrame:
    """A series; equality filters on partition columns prune folders."""
    df = spark.read.schema(schema).parquet(path)
    for name, value in partition.items():
        df = df.where(F.col(name) == value)
    return df


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their keys."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*keys, "_r.*").select(*old.columns)


def prune(df: DataFrame, ts: str, years: int) -> DataFrame:
    """Rows younger than so many years before the newest."""
    newest = df.agg(F.max(ts).alias("_m"))
    return df.join(F.broadcast(newest), F.col(ts) >= F.add_months("_m", -12 * years)).drop("_m")  # one row
