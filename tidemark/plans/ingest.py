"""The parsers over lines and payloads that are written out from the tables, against the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.features import rets, tick_bars
from tidemark.plans.registry import query
from tidemark.sources import parsers as P
from tidemark.sources.tables import BARS_SQL, FUNDING_SQL, TICKS_SQL, bars_1d, funding, ticks

C = F.col
MS = "CAST(epoch_ms(CAST(d AS TIMESTAMP)) AS BIGINT)"


def day_ms(name: str = "d"):
    return F.unix_millis(C(name).cast("timestamp"))


def written_bars(spark, d):
    """Bars as lines of files: every third open time in microseconds, a header for each symbol."""
    b = rets(spark, d)
    t = F.when(C("i") % 3 == 0, day_ms() * 1000).otherwise(day_ms())
    rows = b.select("sym", F.concat_ws(",", t, "o", "h", "l", "c", "vol", t + 1, F.lit("x")).alias("line"))
    return rows.union(rows.select("sym").distinct().select("sym", F.lit("open_time,open,high,low,close,volume,close_time,ignore")))


@query("parsed_klines", f"WITH {BARS_SQL} SELECT sym, {MS} AS ts, round(o, 8) AS o, round(h, 8) AS h, round(l, 8) AS l, round(c, 8) AS c, vol FROM bars")
def parsed_klines(spark, d):
    k = P.klines(written_bars(spark, d))
    return k.select("sym", "ts", *(F.round(x, 8).alias(x) for x in "ohlc"), "vol")


@query("parsed_funding", f"WITH {FUNDING_SQL} SELECT sym, {MS} AS ts, CAST(8 AS INT) AS hours, round(rate * 1e6, 7) AS rate FROM funding")
def parsed_funding(spark, d):
    lines = funding(spark, d).select("sym", F.concat_ws(",", day_ms(), F.lit("8"), "rate").alias("line"))
    return P.funding_rates(lines).select("sym", "ts", "hours", F.round(C("rate") * 1e6, 7).alias("rate"))


@query("parsed_treasury", "WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice) / 1e5, 4) AS v FROM orders GROUP BY 1) SELECT d, CASE WHEN day(d) % 10 <> 0 THEN round(v / 100, 8) END AS rate FROM x WHERE d <= DATE '2000-12-31'")
def parsed_treasury(spark, d):
    """Percentages as fractions; a point stands for a missing value."""
    x = funding(spark, d).groupBy("d").agg(F.round(F.avg(C("rate") * 1e9 + 250000) / 1e5, 4).alias("v"))
    lines = x.select(F.concat_ws(",", C("d").cast("string"), F.when(F.day("d") % 10 == 0, ".").otherwise(C("v").cast("string"))).alias("line")).union(spark.createDataFrame([("observation_date,DTB3",)], "line string"))
    return P.treasury_rates(lines, "2000-12-31").select("d", F.round("rate", 8).alias("rate"))


@query("parsed_euro_rates", "WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice) / 1e5, 4) AS v FROM orders GROUP BY 1) SELECT d, round(v / 100, 8) AS rate FROM x")
def parsed_euro_rates(spark, d):
    x = funding(spark, d).groupBy("d").agg(F.round(F.avg(C("rate") * 1e9 + 250000) / 1e5, 4).alias("v"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    lines = x.select(F.concat_ws(",", q(C("d").cast("string")), q(F.date_format("d", "dd MMM yyyy")), q(C("v").cast("string"))).alias("line"))
    return P.euro_rates(lines).select("d", F.round("rate", 8).alias("rate"))


@query("parsed_rate_payloads", f"WITH {FUNDING_SQL} SELECT sym, d, round(sum(rate) * 1e6, 5) AS rate, count(*) AS n FROM funding GROUP BY sym, d")
def parsed_rate_payloads(spark, d):
    """A JSON document for each series and month, summed up by day."""
    f = funding(spark, d).withColumn("m", F.trunc("d", "month"))
    rates = F.collect_list(F.struct(F.date_format(C("d").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), C("rate").alias("relativeFundingRate")))
    docs = f.groupBy("sym", "m").agg(rates.alias("rates")).select("sym", F.to_json(F.struct("rates")).alias("payload"))
    return P.rate_payloads(docs).select("sym", "d", F.round(C("rate") * 1e6, 5).alias("rate"), "n")


@query("parsed_ohlc_arrays", f"WITH {BARS_SQL} SELECT sym, {MS} // 1000 AS ts, round(o, 8) AS o, round(h, 8) AS h, round(l, 8) AS l, round(c, 8) AS c, vol FROM bars")
def parsed_ohlc_arrays(spark, d):
    b = bars_1d(spark, d).withColumn("m", F.trunc("d", "month"))
    row = F.array(*(x.cast("string") for x in (F.floor(day_ms() / 1000), C("o"), C("h"), C("l"), C("c"), F.lit(0), C("vol"), C("n"))))
    docs = b.groupBy("sym", "m").agg(F.to_json(F.collect_list(row)).alias("payload")).select("sym", "payload")
    return P.ohlc_arrays(docs).select("sym", "ts", *(F.round(x, 8).alias(x) for x in "ohlc"), "vol")


@query("parsed_candles", f"WITH {BARS_SQL} SELECT sym, {MS} AS ts, round(o, 8) AS o, round(h, 8) AS h, round(l, 8) AS l, round(c, 8) AS c, vol FROM bars")
def parsed_candles(spark, d):
    b = bars_1d(spark, d).withColumn("m", F.trunc("d", "month"))
    row = F.struct(day_ms().alias("time"), *(C(a).cast("string").alias(b) for a, b in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("vol", "volume"))))
    docs = b.groupBy("sym", "m").agg(F.collect_list(row).alias("candles")).select("sym", F.to_json(F.struct("candles")).alias("payload"))
    return P.candles(docs).select("sym", "ts", *(F.round(x, 8).alias(x) for x in "ohlc"), "vol")


@query(
    "trade_tape_bars",
    f"WITH {TICKS_SQL} SELECT sym, time_bucket(INTERVAL 5 SECOND, ts) AS ts, round(max(price), 6) AS h, round(min(price), 6) AS l, sum(qty) AS vol, count(*) AS n, sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) AS buy FROM ticks GROUP BY ALL",
)
def trade_tape_bars(spark, d):
    """A tape of trades, written as lines, to bars of five seconds; partial sums merge where a bar's lines lie in several files."""
    t = ticks(spark, d)
    stamp = F.unix_micros(C("ts").cast("timestamp")).cast("decimal(20,0)") / 1_000_000
    lines = t.select(F.concat_ws(",", stamp.cast("decimal(20,6)").cast("string"), "sym", F.initcap("side"), "qty", "price").alias("line"))
    tape = P.trade_tape(lines).withColumn("seq", F.lit(0))
    b = tick_bars(tape, "5 seconds", "left")
    return b.select("sym", "ts", F.round("h", 6).alias("h"), F.round("l", 6).alias("l"), "vol", "n", "buy")


@query(
    "close_panel_grid",
    f"WITH {BARS_SQL}, s AS (SELECT sym, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM bars GROUP BY sym) SELECT s.sym, CAST(epoch_ms(CAST(s.d AS TIMESTAMP)) AS BIGINT) + 86400000 AS ts, round(b.c, 8) AS c, b.c IS NOT NULL AS listed FROM s LEFT JOIN bars b USING (sym, d)",
)
def close_panel_grid(spark, d):
    """Bars that were delivered twice, stamped at their close, on the full daily grid."""
    b = bars_1d(spark, d).select("sym", day_ms().alias("ts"), "c")
    p = P.close_panel(b.union(b.where("ts % 7 = 0")))
    return p.select("sym", "ts", F.round("c", 8).alias("c"), "listed")


@query("spot_panel", f"WITH {BARS_SQL} SELECT replace(sym, 'O', 'F') AS sym, CAST(epoch_ms(CAST(d AS TIMESTAMP)) AS BIGINT) + 86400000 AS ts, round(c * CASE WHEN sym = 'AO' THEN 1000 ELSE 1 END, 6) AS c FROM bars WHERE sym LIKE '%O'")
def spot_panel(spark, d):
    """Spot bars under the names of their contracts, in the contracts' units."""
    mapping = spark.createDataFrame([("AO", "AF", 1000.0), ("NO", "NF", 1.0), ("RO", "RF", 1.0)], "sym string, as_sym string, factor double")
    b = bars_1d(spark, d).select("sym", day_ms().alias("ts"), "c").join(F.broadcast(mapping), "sym")  # a fixed table
    p = P.close_panel(b.select(C("as_sym").alias("sym"), "ts", (C("c") * C("factor")).alias("c"))).where("listed")
    return p.select("sym", "ts", F.round("c", 6).alias("c"))


@query(
    "pit_partitions",
    f"WITH {BARS_SQL}, {FUNDING_SQL}, x AS (SELECT 'ohlcv' AS dataset, sym, d, '1d' AS g, 86400000000000 AS lag FROM bars UNION ALL SELECT 'funding', sym, d, '8h', 0 FROM funding) SELECT dataset, sym AS symbol, g AS granularity, year(d) || '-01-01' AS date, count(*) AS n, max(CAST(epoch_ms(CAST(d AS TIMESTAMP)) AS BIGINT) * 1000000 + lag) AS known_ns FROM x GROUP BY ALL",
)
def pit_partitions(spark, d):
    """Rows and the last known time of each partition that the sources would write."""
    bars = P.ohlcv_pit(bars_1d(spark, d).select("sym", day_ms().alias("ts"), "c"))
    rates = P.funding_pit(funding(spark, d).select("sym", day_ms().alias("ts"), "rate"))
    both = bars.unionByName(rates, allowMissingColumns=True)
    return both.groupBy("dataset", "symbol", "granularity", "date").agg(F.count("*").alias("n"), F.max("asof_ts_ns").alias("known_ns"))
