"""Append-only ledgers, registered reads and further ways into the point-in-time store."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from tidemark.sources import store


def record(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; nothing that is there is ever touched."""
    df.write.mode("append").json(path)


def entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a ledger; none where it hasn't been opened."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The entry with the highest version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def gate_slice(df: DataFrame, day: str, split: str, path: str, hypothesis: str, before: bool = False) -> DataFrame:
    """Rows from the split on (before: those before it), once for each hypothesis: the read is registered first, and a second one is refused."""
    spark = df.sparkSession
    schema = "hypothesis string, split string, side string"
    side = "before" if before else "after"
    if not entries(spark, path, schema).where((F.col("hypothesis") == hypothesis) & (F.col("side") == side)).isEmpty():
        raise PermissionError(f"{hypothesis} has read its slice already")
    record(spark.createDataFrame([(hypothesis, split, side)], schema), path)
    at = F.lit(split).cast("date")
    return df.where(F.col(day) < at if before else F.col(day) >= at)


def partitions(spark: SparkSession, path: str, **only: str) -> DataFrame:
    """The partitions of a store with their numbers of rows; equality filters prune folders."""
    df = spark.read.parquet(path)
    for name, value in only.items():
        df = df.where(F.col(name) == value)
    return df.groupBy(*store.PARTITION).agg(F.count("*").alias("n"))


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """A sidecar beside a store's partitions, readable by every task."""
    record(spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string"), f"{path}/_meta")


def read_meta(spark: SparkSession, path: str) -> list[dict]:
    return [json.loads(r["meta"]) for r in spark.read.schema("meta string").json(f"{path}/_meta").collect()]


def read_validated(spark: SparkSession, path: str, schema, columns: list[str], checks: dict[str, Column]) -> DataFrame:
    """A column-pruned read whose rows keep the contract; raises otherwise."""
    df = spark.read.schema(schema).parquet(path).select(*columns)
    store.check(df, checks)
    return df


def backfill(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """Files of one symbol each, with the symbol from the file's or folder's name."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([A-Za-z0-9]+)(?:\.parquet)?(?:/part-[^/]*)?$", 1)
    return spark.read.schema(schema).parquet(pattern).select("*", name.alias("symbol"))


def ingest(df: DataFrame, path: str, now_ns: int, checks: dict[str, Column]) -> dict[str, int]:
    """Drops what isn't known yet, checks the contract, and appends new partitions. df: rows of the parsers' PIT shape."""
    known = df.where(F.col("asof_ts_ns") <= now_ns)
    store.check(known, checks)
    total, kept = df.count(), known.count()
    return {"rows": kept, "not_known_yet": total - kept, "partitions": store.append(known, path)}
