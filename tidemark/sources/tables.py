"""The logical inputs, derived from the tables of a folder; the SQL twins stand beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = ["AF", "AO", "NF", "NO", "RF", "RO"]
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

#: SQL of the same inputs, as common table expressions.
TICKS_SQL = """ticks AS (SELECT event_type AS sym, ts, event_id AS seq, value AS price, CAST(1 + user_id % 10 AS DOUBLE) AS qty,
 CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM events)"""
TRADES_SQL = """trades AS (SELECT l_returnflag || l_linestatus AS sym, CAST(l_shipdate AS DATE) AS d, l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity AS qty,
 CASE WHEN l_linenumber % 2 = 1 THEN 'buy' ELSE 'sell' END AS side, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""
BARS_SQL = (
    TRADES_SQL
    + """, bars AS (SELECT sym, d, first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o, max(price) AS h, min(price) AS l,
 last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS c, sum(qty) AS vol, round(sum(l_extendedprice), 2) AS notional,
 sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) AS buy, sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) AS sell, count(*) AS n FROM trades GROUP BY sym, d),
 rets AS (SELECT *, c / nullif(lag(c) OVER w, 0) - 1 AS r, ln(CASE WHEN c / nullif(lag(c) OVER w, 0) > 0 THEN c / lag(c) OVER w END) AS lr, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d))"""
)
FUNDING_SQL = """funding AS (SELECT CASE o_custkey % 6 WHEN 0 THEN 'AF' WHEN 1 THEN 'AO' WHEN 2 THEN 'NF' WHEN 3 THEN 'NO' WHEN 4 THEN 'RF' ELSE 'RO' END AS sym,
 CAST(o_orderdate AS DATE) AS d, o_orderkey AS seq, (o_totalprice - 250000) / 1e9 AS rate FROM orders)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("sym"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), (1 + F.col("user_id") % 10).cast("double").alias("qty"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side")
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("sym"), F.to_date("l_shipdate").alias("d"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("qty"),
        F.when(F.col("l_linenumber") % 2 == 1, "buy").otherwise("sell").alias("side"), *TIE,
    )


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: one partial aggregation and one shuffle by (sym, d)."""
    tie = F.struct(*TIE)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0.0))
    return trades(spark, sf_dir).groupBy("sym", "d").agg(
        F.min_by("price", tie).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", tie).alias("c"), F.sum("qty").alias("vol"), F.round(F.sum("l_extendedprice"), 2).alias("notional"),
        side("buy").alias("buy"), side("sell").alias("sell"), F.count("*").alias("n"),
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    sym = F.coalesce(F.get(F.array(*(F.lit(s) for s in SYMBOLS)), (F.col("o_custkey") % 6).cast("int")), F.lit("RO"))
    return o.select(sym.alias("sym"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("seq"), ((F.col("o_totalprice") - 250000) / 1e9).alias("rate"))
