"""Files and payloads of market data as DataFrames: delimited lines and JSON documents, parsed in one pass without inference.

Every parser takes a DataFrame with the text in a column, so that files (``spark.read.text``, which opens gzip by itself), tables and
streams are read alike. Lines that don't parse, headers among them, give no row; a number that isn't one is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Milliseconds of this size are microseconds: a repair of exports that changed their unit.
MICROS = 100_000_000_000_000
DAY_NS = 86_400_000_000_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files, gzipped or not, with the name of their file."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def _fields(df: DataFrame, names: str, line: str = "line") -> DataFrame:
    """The fields of comma-separated lines as strings; other columns stay."""
    schema = ", ".join(f"{n} string" for n in names.split())
    parsed = df.withColumn("_f", F.from_csv(F.col(line), schema, {"mode": "PERMISSIVE"}))
    return parsed.select(*(c for c in df.columns if c != line), "_f.*")


def _number(name: str, kind: str = "double") -> Column:
    return F.col(name).try_cast(kind)


def millis(name: str) -> Column:
    """Epoch milliseconds, from microseconds where the number is too large for them."""
    t = _number(name, "long")
    return F.when(t > MICROS, F.floor(t / 1000)).otherwise(t)


def klines(df: DataFrame, line: str = "line") -> DataFrame:
    """open_time,open,high,low,close,volume,close_time,... with or without a header: ts (ms), o, h, l, c, vol."""
    x = _fields(df, "open_time open high low close volume close_time", line)
    rest = [c for c in df.columns if c != line]
    return x.select(*rest, millis("open_time").alias("ts"), *(_number(a).alias(b) for a, b in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "vol")))).where("ts is not null")


def funding_rates(df: DataFrame, line: str = "line") -> DataFrame:
    """calc_time,funding_interval_hours,last_funding_rate: ts (ms), hours, rate."""
    x = _fields(df, "calc_time hours rate", line)
    return x.select(*(c for c in df.columns if c != line), millis("calc_time").alias("ts"), _number("hours", "int").alias("hours"), _number("rate").alias("rate")).where("ts is not null")


def treasury_rates(df: DataFrame, last_day: str | None = None, line: str = "line") -> DataFrame:
    """observation_date,percent with a point for a missing value: d, rate as a fraction; days after last_day are left out."""
    x = _fields(df, "day value", line).select(*(c for c in df.columns if c != line), _number("day", "date").alias("d"), (_number("value") / 100).alias("rate")).where("d is not null")
    return x if last_day is None else x.where(F.col("d") <= F.lit(last_day).cast("date"))


def euro_rates(df: DataFrame, line: str = "line") -> DataFrame:
    """"day","period","percent" with quotes: d, rate as a fraction."""
    x = _fields(df, "day period value", line)
    return x.select(*(c for c in df.columns if c != line), _number("day", "date").alias("d"), (_number("value") / 100).alias("rate")).where("d is not null")


def rate_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """{"rates": [{"timestamp", "relativeFundingRate"}]}: summed by UTC day: d, rate, n."""
    rest = [c for c in df.columns if c != payload]
    x = df.select(*rest, F.inline(F.from_json(payload, "rates array<struct<timestamp: timestamp, relativeFundingRate: double>>")["rates"]))
    return x.groupBy(*rest, F.to_date("timestamp").alias("d")).agg(F.sum("relativeFundingRate").alias("rate"), F.count("*").alias("n"))


def ohlc_arrays(df: DataFrame, payload: str = "payload") -> DataFrame:
    """[[seconds, "o", "h", "l", "c", "vwap", "vol", n], ...]: ts (s), o, h, l, c, vol."""
    rest = [c for c in df.columns if c != payload]
    x = df.select(*rest, F.explode(F.from_json(payload, "array<array<string>>")).alias("a"))
    return x.select(*rest, F.col("a")[0].try_cast("long").alias("ts"), *(F.col("a")[i].try_cast("double").alias(n) for i, n in ((1, "o"), (2, "h"), (3, "l"), (4, "c"), (6, "vol"))))


def candles(df: DataFrame, payload: str = "payload") -> DataFrame:
    """{"candles": [{"time", "open", "high", "low", "close", "volume"}]}: ts (ms), o, h, l, c, vol."""
    rest = [c for c in df.columns if c != payload]
    x = df.select(*rest, F.inline(F.from_json(payload, "candles array<struct<time: long, open: string, high: string, low: string, close: string, volume: string>>")["candles"]))
    return x.select(*rest, F.col("time").alias("ts"), *(_number(a).alias(b) for a, b in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "vol"))))


def trade_tape(df: DataFrame, line: str = "line") -> DataFrame:
    """timestamp (s),symbol,side,size,price,...: sym, ts, side, qty, price, for bars of any size."""
    x = _fields(df, "timestamp symbol side size price", line)
    x = x.select(F.col("symbol").alias("sym"), F.timestamp_micros((_number("timestamp") * 1_000_000).cast("long")).alias("ts"), F.lower("side").alias("side"), _number("size").alias("qty"), _number("price").alias("price"))
    return x.where("ts is not null and price is not null")


def close_panel(bars: DataFrame, by: str = "sym", ts: str = "ts", step: int = 86_400_000) -> DataFrame:
    """Repeated bars once, stamped at their close, on each series' full grid: by, ts, the bar's columns, listed (whether there is a bar)."""
    rest = [c for c in bars.columns if c not in (by, ts)]
    one = bars.groupBy(by, (F.col(ts) + step).alias(ts)).agg(F.max_by(F.struct(*rest), F.struct(*rest)).alias("_r")).select(by, ts, "_r.*")
    grid = one.groupBy(by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).select(by, F.explode(F.sequence("_a", "_b", F.lit(step).cast("long"))).alias(ts))
    return grid.join(one.withColumn("listed", F.lit(True)), [by, ts], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def pit(df: DataFrame, event_ms: Column, known_ms: Column, dataset: str, symbol: Column, granularity: str, asset_class: str = "crypto") -> DataFrame:
    """Rows with event_ts_ns, asof_ts_ns and the keys of the point-in-time store; daily series have a partition a year, others one a day."""
    pattern = "yyyy-01-01" if granularity in ("1d", "8h", "4h") else "yyyy-MM-dd"
    day = F.date_format(F.timestamp_millis(event_ms), pattern)
    return df.withColumns({
        "event_ts_ns": event_ms * 1_000_000, "asof_ts_ns": known_ms * 1_000_000, "asset_class": F.lit(asset_class), "dataset": F.lit(dataset), "symbol": symbol, "granularity": F.lit(granularity), "date": day,
    })


def ohlcv_pit(bars: DataFrame, granularity: str = "1d", step: int = 86_400_000) -> DataFrame:
    """Bars are known at their close."""
    return pit(bars, F.col("ts"), F.col("ts") + step, "ohlcv", F.col("sym"), granularity)


def funding_pit(rates: DataFrame, granularity: str = "8h") -> DataFrame:
    """Rates are known when they settle."""
    return pit(rates, F.col("ts"), F.col("ts"), "funding", F.col("sym"), granularity)


def open_interest_pit(levels: DataFrame, granularity: str = "1d") -> DataFrame:
    return pit(levels, F.col("ts"), F.col("ts"), "open_interest", F.col("sym"), granularity)
