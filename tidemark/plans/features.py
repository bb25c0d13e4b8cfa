"""Bars, features and cross-sections."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import sequential as S
from tidemark.operators import windows as W
from tidemark.plans.registry import out, query
from tidemark.sources.tables import BARS_SQL, FUNDING_SQL, TICKS_SQL, bars_1d, funding, ticks

C = F.col


def floor0(x):
    """The root of x, of 0 where x is below it, and null where x is."""
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))


def rets(spark, d) -> DataFrame:
    return W.returns(bars_1d(spark, d))


@query("ohlcv_1d", f"WITH {BARS_SQL} SELECT sym, d, round(o, 8) AS o, round(h, 8) AS h, round(l, 8) AS l, round(c, 8) AS c, vol, notional, n FROM bars")
def ohlcv_1d(spark, d):
    return bars_1d(spark, d).select("sym", "d", *(F.round(x, 8).alias(x) for x in "ohlc"), "vol", "notional", "n")


def tick_bars(t: DataFrame, size: str, closed: str) -> DataFrame:
    """Time bars. closed="left": [start, start + size), stamped by start; "right": (start, start + size], stamped by their end."""
    ts = C("ts") if closed == "left" else C("ts") - F.expr("interval 1 microsecond")
    w = F.window(ts, size)
    side = lambda s: F.sum(F.when(C("side") == s, C("qty")).otherwise(0.0))
    order = F.struct("ts", "seq")
    g = t.groupBy("sym", w.alias("w")).agg(F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.sum("qty").alias("vol"), F.count("*").alias("n"), side("buy").alias("buy"), side("sell").alias("sell"))
    return g.select("sym", C("w.start" if closed == "left" else "w.end").cast("timestamp_ntz").alias("ts"), "o", "h", "l", "c", "vol", "n", "buy", "sell")


TICK_BARS = """SELECT sym, {label} AS ts, first(price ORDER BY ts, seq) AS o, max(price) AS h, min(price) AS l, last(price ORDER BY ts, seq) AS c, sum(qty) AS vol, count(*) AS n,
 sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) AS buy, sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) AS sell FROM ticks GROUP BY sym, {label}"""


@query("ohlcv_1h_ticks", f"WITH {TICKS_SQL} " + TICK_BARS.format(label="date_trunc('hour', ticks.ts)"))
def ohlcv_1h(spark, d):
    return tick_bars(ticks(spark, d), "1 hour", "left")


@query("ohlcv_5s_right_closed", f"WITH {TICKS_SQL} " + TICK_BARS.format(label="time_bucket(INTERVAL 5 SECOND, ticks.ts - INTERVAL 1 MICROSECOND) + INTERVAL 5 SECOND"))
def ohlcv_5s(spark, d):
    return tick_bars(ticks(spark, d), "5 seconds", "right")


@query("bars_epoch_aligned_15m", f"WITH {TICKS_SQL} " + TICK_BARS.format(label="time_bucket(INTERVAL 15 MINUTE, ticks.ts)"))
def bars_15m(spark, d):
    return tick_bars(ticks(spark, d), "15 minutes", "left")


def _roll(name: str, x: str, how: str, n: int, sql: str):
    """A rolling statistic of the daily returns, null before it is full."""
    full = f"CASE WHEN count({x}) OVER f >= {n} THEN {sql} END"
    text = f"WITH {BARS_SQL} SELECT sym, d, round({full}, 6) AS v FROM rets WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    @query(name, text)
    def run(spark, d):
        return out(rets(spark, d), "sym", "d", v=W.rolling(C(x), how, n))


_roll("vol_realized_20", "lr", "std", 20, "stddev_samp(lr) OVER f")
_roll("roll_mean_50", "c", "mean", 50, "avg(c) OVER f")
_roll("roll_max_20", "h", "max", 20, "max(h) OVER f")
_roll("roll_min_20", "l", "min", 20, "min(l) OVER f")
_roll("roll_median_21", "lr", "median", 21, "quantile_cont(lr, 0.5) OVER f")
_roll("roll_q05_60", "lr", "q05", 60, "quantile_cont(lr, 0.05) OVER f")
_roll("roll_skew_60", "lr", "skew", 60, "skewness(lr) OVER f")

RANGE = "WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


def _range_vol(name: str, spark_x, sql_x: str):
    """Square root of the 20-row mean of a variance estimate of single bars."""

    @query(name, f"WITH {BARS_SQL}, e AS (SELECT sym, d, {sql_x} AS x FROM (SELECT *, lag(c) OVER (PARTITION BY sym ORDER BY d) AS pc FROM bars)) SELECT sym, d, round(CASE WHEN count(x) OVER f >= 20 THEN sqrt(greatest(avg(x) OVER f, 0)) END, 6) AS v FROM e {RANGE}")
    def run(spark, d):
        b = bars_1d(spark, d).withColumn("pc", F.lag("c").over(W.series())).withColumn("x", spark_x())
        return out(b, "sym", "d", v=floor0(W.rolling(C("x"), "mean", 20)))


_ln = lambda a, b: F.log(C(a) / C(b))
_range_vol("vol_parkinson", lambda: _ln("h", "l") ** 2 / (4 * math.log(2)), "ln(h / l) ** 2 / (4 * ln(2.0))")
_range_vol("vol_garman_klass", lambda: 0.5 * _ln("h", "l") ** 2 - (2 * math.log(2) - 1) * _ln("c", "o") ** 2, "0.5 * ln(h / l) ** 2 - (2 * ln(2.0) - 1) * ln(c / o) ** 2")
_range_vol("vol_rogers_satchell", lambda: _ln("h", "c") * _ln("h", "o") + _ln("l", "c") * _ln("l", "o"), "ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)")


@query(
    "vol_yang_zhang",
    f"""WITH {BARS_SQL}, e AS (SELECT sym, d, ln(o / lag(c) OVER (PARTITION BY sym ORDER BY d)) AS ov, ln(c / o) AS oc, ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o) AS rs FROM bars)
    SELECT sym, d, round(CASE WHEN count(ov) OVER f >= 20 THEN sqrt(greatest(var_samp(ov) OVER f + (0.34 / (1.34 + 21.0 / 19)) * (var_samp(oc) OVER f) + (1 - 0.34 / (1.34 + 21.0 / 19)) * (avg(rs) OVER f), 0)) END, 6) AS v FROM e {RANGE}""",
)
def vol_yz(spark, d):
    f, k = W.trailing(20), 0.34 / (1.34 + 21.0 / 19)
    b = bars_1d(spark, d).withColumn("ov", F.log(C("o") / F.lag("c").over(W.series()))).withColumn("oc", _ln("c", "o")).withColumn("rs", _ln("h", "c") * _ln("h", "o") + _ln("l", "c") * _ln("l", "o"))
    return out(b, "sym", "d", v=W.full(F.sqrt(F.greatest(F.var_samp("ov").over(f) + k * F.var_samp("oc").over(f) + (1 - k) * F.avg("rs").over(f), F.lit(0.0))), C("ov"), 20, f))


@query(
    "vol_bipower_jump",
    f"""WITH {BARS_SQL}, e AS (SELECT sym, d, lr * lr AS q, abs(lr) * abs(lag(lr) OVER (PARTITION BY sym ORDER BY d)) AS b FROM rets)
    SELECT sym, d, round(CASE WHEN count(b) OVER f >= 20 THEN greatest(sum(q) OVER f - pi() / 2 * (sum(b) OVER f), 0) END, 6) AS v FROM e {RANGE}""",
)
def vol_bns(spark, d):
    e = rets(spark, d).withColumn("q", C("lr") ** 2).withColumn("b", F.abs("lr") * F.abs(F.lag("lr").over(W.series())))
    f = W.trailing(20)
    return out(e, "sym", "d", v=W.full(F.greatest(F.sum("q").over(f) - math.pi / 2 * F.sum("b").over(f), F.lit(0.0)), C("b"), 20, f))


def _ewm(name: str, x: str, alpha: float, adjust: bool):
    """Exponentially weighted mean over all rows so far, streamed through."""
    seed = "1.0" if adjust else f"CASE WHEN b.i = m.i0 THEN 1.0 ELSE {alpha} END"
    sql = f"""WITH {BARS_SQL}, m AS (SELECT sym, d, i, min(CASE WHEN {x} IS NOT NULL THEN i END) OVER (PARTITION BY sym) AS i0 FROM rets)
    SELECT m.sym, CAST(m.i AS BIGINT) AS at, round(sum(pow({1 - alpha}, m.i - b.i) * {seed} * b.{x}) / sum(pow({1 - alpha}, m.i - b.i) * {seed}), 6) AS v
    FROM m LEFT JOIN rets b ON b.sym = m.sym AND b.i <= m.i AND b.{x} IS NOT NULL GROUP BY m.sym, m.i"""

    @query(name, sql)
    def run(spark, d):
        return folded(rets(spark, d).withColumn("x", C(x)), S.ewm_step(alpha, adjust), "x")


def folded(b: DataFrame, maker, x: str) -> DataFrame:
    """sym, at (the row's number), v: what a step function of one value gives for each row."""
    start, step = maker
    b = b.select("sym", C("i").cast("long").alias("i"), C(x).alias("x"))
    done = S.fold(b, "sym", ["i"], ["i", "x"], start, step, "sym string, at long, v double", ["sym", "at", "v"], [pa.string(), pa.int64(), pa.float64()])
    return out(done, "sym", "at", v=C("v"))


_ewm("ewm_adjust_true", "lr", 0.2, True)
_ewm("ewm_adjust_false", "lr", 0.2, False)


@query(
    "vol_ewma94",
    f"""WITH {BARS_SQL}, k AS (SELECT sym, i, lr, count(lr) OVER (PARTITION BY sym ORDER BY i) AS n FROM rets), s AS (SELECT sym, avg(lr * lr) AS seed, max(i) AS i0 FROM k WHERE n <= 20 AND lr IS NOT NULL GROUP BY sym),
    e AS (SELECT m.sym, m.i, pow(0.94, m.i - 1 - s.i0) * any_value(s.seed) + coalesce(sum(0.06 * pow(0.94, m.i - 1 - b.i) * b.lr * b.lr), 0) AS v
    FROM k m JOIN s USING (sym) LEFT JOIN k b ON b.sym = m.sym AND b.i > s.i0 AND b.i < m.i AND b.lr IS NOT NULL WHERE m.i > s.i0 GROUP BY m.sym, m.i, s.i0)
    SELECT m.sym, CAST(m.i AS BIGINT) AS at, round(sqrt(e.v), 6) AS v FROM rets m LEFT JOIN e USING (sym, i)""",
)
def vol_ewma94(spark, d):
    """Known before the bar: seeded with the mean square of 20 returns, then a recursion without an end."""
    start, step = S.seeded_variance_step(0.94, 20)
    b = rets(spark, d).select("sym", C("i").cast("long").alias("i"), "lr")
    done = S.fold(b, "sym", ["i"], ["i", "lr"], start, step, "sym string, at long, v double", ["sym", "at", "v"], [pa.string(), pa.int64(), pa.float64()])
    return out(done, "sym", "at", v=F.sqrt("v"))


@query(
    "zscore_expanding",
    f"""WITH {BARS_SQL} SELECT sym, d, round(CASE WHEN count(lr) OVER f >= 30 AND stddev_samp(lr) OVER f > 0 THEN (lr - avg(lr) OVER f) / (stddev_samp(lr) OVER f) END, 6) AS v
    FROM rets WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def zscore_expanding(spark, d):
    return out(rets(spark, d), "sym", "d", v=W.zscore_expanding(C("lr"), 30))


@query(
    "winsor_rolling",
    f"""WITH {BARS_SQL} SELECT sym, d, round(CASE WHEN count(lr) OVER f >= 40 THEN least(greatest(lr, quantile_cont(lr, 0.05) OVER f), quantile_cont(lr, 0.95) OVER f) END, 6) AS v
    FROM rets WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)""",
)
def winsor_rolling(spark, d):
    return out(rets(spark, d), "sym", "d", v=W.winsor_rolling(C("lr"), 40, 0.05, 0.95))


@query("mom_skip", f"WITH {BARS_SQL} SELECT sym, d, round(ln(lag(c, 5) OVER w / lag(c, 60) OVER w), 6) AS v FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)")
def mom_skip(spark, d):
    return out(bars_1d(spark, d), "sym", "d", v=F.log(F.lag("c", 5).over(W.series()) / F.lag("c", 60).over(W.series())))


@query(
    "xs_rank_average",
    f"WITH {BARS_SQL} SELECT sym, d, round(CASE WHEN r IS NOT NULL THEN rank() OVER (PARTITION BY d ORDER BY r) + (count(*) OVER (PARTITION BY d, r) - 1) / 2.0 END, 6) AS v FROM rets WHERE r IS NOT NULL",
)
def xs_rank(spark, d):
    return out(rets(spark, d).where("r is not null"), "sym", "d", v=W.rank_average(C("r"), Window.partitionBy("d")))


@query(
    "xs_zscore",
    f"WITH {BARS_SQL} SELECT sym, d, round(CASE WHEN count(r) OVER x >= 3 AND stddev_samp(r) OVER x > 0 THEN (r - avg(r) OVER x) / (stddev_samp(r) OVER x) END, 6) AS v FROM rets WINDOW x AS (PARTITION BY d)",
)
def xs_zscore(spark, d):
    x = W.cross()
    sd = F.stddev_samp("r").over(x)
    return out(rets(spark, d), "sym", "d", v=F.when((F.count("r").over(x) >= 3) & (sd > 0), (C("r") - F.avg("r").over(x)) / sd))


@query(
    "xs_rank_normalised",
    f"WITH {BARS_SQL} SELECT sym, d, round(CASE WHEN count(*) OVER (PARTITION BY d) >= 3 THEN 2.0 * (row_number() OVER (PARTITION BY d ORDER BY r, sym) - 1) / (count(*) OVER (PARTITION BY d) - 1) - 1 ELSE 0 END, 6) AS v FROM rets WHERE r IS NOT NULL",
)
def xs_rank_normalised(spark, d):
    x = W.cross()
    n = F.count("*").over(x)
    return out(rets(spark, d).where("r is not null"), "sym", "d", v=F.when(n >= 3, 2.0 * (F.row_number().over(x.orderBy("r", "sym")) - 1) / (n - 1) - 1).otherwise(0.0))


@query(
    "universe_topn",
    f"""WITH {BARS_SQL}, e AS (SELECT sym, d, i, avg(notional) OVER f AS adv, stddev_samp(lr) OVER f AS sd FROM rets WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
    g AS (SELECT *, i >= 60 AND adv >= 1000 AND sd >= 0.001 AS ok FROM e)
    SELECT sym, d, round(adv, 5) AS adv, row_number() OVER (PARTITION BY d ORDER BY adv DESC, sym) AS place FROM g WHERE ok QUALIFY row_number() OVER (PARTITION BY d ORDER BY adv DESC, sym) <= 3""",
)
def universe_topn(spark, d):
    f = W.trailing(30)
    e = rets(spark, d).withColumn("adv", F.avg("notional").over(f)).withColumn("sd", F.stddev_samp("lr").over(f)).where("i >= 60 and adv >= 1000 and sd >= 0.001")
    e = e.withColumn("place", F.row_number().over(W.cross().orderBy(C("adv").desc(), "sym"))).where("place <= 3")
    return e.select("sym", "d", F.round("adv", 5).alias("adv"), C("place").cast("long").alias("place"))


@query(
    "rsi14",
    f"""WITH {BARS_SQL}, e AS (SELECT sym, d, greatest(c - lag(c) OVER w, 0) AS up, greatest(lag(c) OVER w - c, 0) AS down FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d))
    SELECT sym, d, round(CASE WHEN count(up) OVER f >= 14 THEN CASE WHEN sum(down) OVER f > 0 THEN 100 - 100 / (1 + (sum(up) OVER f) / (sum(down) OVER f)) ELSE 100 END END, 6) AS v
    FROM (SELECT sym, d, CASE WHEN row_number() OVER (PARTITION BY sym ORDER BY d) > 1 THEN up END AS up, CASE WHEN row_number() OVER (PARTITION BY sym ORDER BY d) > 1 THEN down END AS down FROM e) WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
)
def rsi14(spark, d):
    step = C("c") - F.lag("c").over(W.series())
    b = bars_1d(spark, d).withColumn("up", F.when(step.isNotNull(), F.greatest(step, F.lit(0.0)))).withColumn("down", F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))))
    up, down = W.rolling(C("up"), "sum", 14), W.rolling(C("down"), "sum", 14)
    return out(b, "sym", "d", v=F.when(down > 0, 100 - 100 / (1 + up / down)).when(up.isNotNull(), 100.0))


TRUE_RANGE = "greatest(h - l, coalesce(abs(h - lag(c) OVER w), 0), coalesce(abs(l - lag(c) OVER w), 0))"


def true_range():
    pc = F.lag("c").over(W.series())
    return F.greatest(C("h") - C("l"), F.coalesce(F.abs(C("h") - pc), F.lit(0.0)), F.coalesce(F.abs(C("l") - pc), F.lit(0.0)))


@query("atr14", f"WITH {BARS_SQL}, e AS (SELECT sym, d, {TRUE_RANGE} AS tr FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)) SELECT sym, d, round(CASE WHEN count(tr) OVER f >= 14 THEN avg(tr) OVER f END, 6) AS v FROM e WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)")
def atr14(spark, d):
    return out(bars_1d(spark, d).withColumn("tr", true_range()), "sym", "d", v=W.rolling(C("tr"), "mean", 14))


@query(
    "breakout_20",
    f"WITH {BARS_SQL} SELECT sym, d, CASE WHEN c > max(h) OVER f THEN 1 WHEN c < min(l) OVER f THEN -1 ELSE 0 END AS v FROM bars WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
)
def breakout(spark, d):
    f = W.series().rowsBetween(-20, -1)
    return bars_1d(spark, d).select("sym", "d", F.when(C("c") > F.max("h").over(f), 1).when(C("c") < F.min("l").over(f), -1).otherwise(0).alias("v"))


@query("vwap_distance", f"WITH {BARS_SQL} SELECT sym, d, round(c / (sum(notional) OVER f / sum(vol) OVER f) - 1, 6) AS v FROM bars WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def vwap(spark, d):
    f = W.trailing(20)
    return out(bars_1d(spark, d), "sym", "d", v=C("c") / (F.sum("notional").over(f) / F.sum("vol").over(f)) - 1)


@query("autocorr_60", f"WITH {BARS_SQL}, e AS (SELECT *, lag(lr) OVER (PARTITION BY sym ORDER BY d) AS pr FROM rets) SELECT sym, d, round(CASE WHEN count(pr) OVER f >= 60 THEN corr(lr, pr) OVER f END, 5) AS v FROM e WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def autocorr(spark, d):
    f = W.trailing(60)
    e = rets(spark, d).withColumn("pr", F.lag("lr").over(W.series()))
    return out(e, "sym", "d", digits=5, v=W.full(F.corr("lr", "pr").over(f), C("pr"), 60, f))


@query(
    "hour_of_week_threshold",
    f"""WITH {TICKS_SQL}, h AS (SELECT sym, date_trunc('hour', ts) AS ts, sum(price * qty) AS x FROM ticks GROUP BY 1, 2), k AS (SELECT *, (isodow(ts) - 1) * 24 + hour(ts) AS bucket FROM h)
    SELECT sym, ts, CAST(bucket AS INT) AS bucket, round(avg(x) OVER (PARTITION BY sym, bucket ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS v FROM k""",
)
def hour_of_week(spark, d):
    """The seasonal level known before the hour."""
    h = ticks(spark, d).groupBy("sym", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum(C("price") * C("qty")).alias("x"))
    h = h.withColumn("bucket", (F.weekday("ts") * 24 + F.hour("ts")).cast("int"))
    w = Window.partitionBy("sym", "bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return out(h, "sym", "ts", "bucket", digits=4, v=F.avg("x").over(w))


def ffd_weights(order: float, size: int) -> list[float]:
    w = [1.0]
    for k in range(1, size):
        w.append(-w[-1] * (order - k + 1) / k)
    return w


FFD = ffd_weights(0.4, 20)


@query("fracdiff_d04", f"WITH {BARS_SQL} SELECT sym, d, round(" + " + ".join(f"({w!r}) * ln(lag(c, {k}) OVER w)" for k, w in enumerate(FFD)) + ", 6) AS v FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)")
def fracdiff(spark, d):
    w = W.series()
    v = sum((x * F.log(F.lag("c", k).over(w) if k else C("c")) for k, x in enumerate(FFD)), F.lit(0.0))
    return out(bars_1d(spark, d), "sym", "d", v=v)


@query("amihud_20", f"WITH {BARS_SQL} SELECT sym, d, round(CASE WHEN count(r) OVER f >= 20 THEN avg(abs(r) / notional) OVER f * 1e6 END, 6) AS v FROM rets {RANGE}")
def amihud(spark, d):
    e = rets(spark, d).withColumn("x", F.abs("r") / C("notional"))
    return out(e, "sym", "d", v=W.rolling(C("x"), "mean", 20) * 1e6)


@query(
    "corwin_schultz",
    f"""WITH {BARS_SQL}, e AS (SELECT sym, d, ln(h / l) ** 2 + lag(ln(h / l) ** 2) OVER w AS b, ln(greatest(h, lag(h) OVER w) / least(l, lag(l) OVER w)) ** 2 AS g, lag(h) OVER w AS ph FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)),
    a AS (SELECT sym, d, (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2.0)) - sqrt(g / (3 - 2 * sqrt(2.0))) AS a FROM e WHERE ph IS NOT NULL)
    SELECT sym, d, round(greatest(2 * (exp(a) - 1) / (1 + exp(a)), 0), 6) AS v FROM a""",
)
def corwin_schultz(spark, d):
    w, k = W.series(), 3 - 2 * math.sqrt(2)
    q = _ln("h", "l") ** 2
    b = bars_1d(spark, d).withColumn("b", q + F.lag(q).over(w)).withColumn("g", F.log(F.greatest("h", F.lag("h").over(w)) / F.least("l", F.lag("l").over(w))) ** 2).where("b is not null")
    a = (F.sqrt(2 * C("b")) - F.sqrt("b")) / k - F.sqrt(C("g") / k)
    return out(b, "sym", "d", v=F.greatest(2 * (F.exp(a) - 1) / (1 + F.exp(a)), F.lit(0.0)))


@query(
    "abdi_ranaldo",
    f"""WITH {BARS_SQL}, e AS (SELECT sym, d, ln(lag(c) OVER w) - (ln(lag(h) OVER w) + ln(lag(l) OVER w)) / 2 AS x, ln(lag(c) OVER w) - (ln(h) + ln(l)) / 2 AS y FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d))
    SELECT sym, d, round(CASE WHEN count(x) OVER f >= 20 THEN sqrt(greatest(4 * (avg(x * y) OVER f), 0)) END, 5) AS v FROM e {RANGE}""",
)
def abdi_ranaldo(spark, d):
    w = W.series()
    mid = (F.log("h") + F.log("l")) / 2
    e = bars_1d(spark, d).withColumn("p", (F.log(F.lag("c").over(w)) - F.lag(mid).over(w)) * (F.log(F.lag("c").over(w)) - mid))
    return out(e, "sym", "d", digits=5, v=floor0(4 * W.rolling(C("p"), "mean", 20)))


@query("ofi_signal", f"WITH {BARS_SQL}, e AS (SELECT sym, d, (buy - sell) / (buy + sell) AS x FROM bars) SELECT sym, d, round(CASE WHEN count(x) OVER f >= 10 THEN tanh(2 * (avg(x) OVER f)) END, 6) AS v FROM e WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def ofi(spark, d):
    e = bars_1d(spark, d).withColumn("x", (C("buy") - C("sell")) / (C("buy") + C("sell")))
    return out(e, "sym", "d", v=F.tanh(2 * W.rolling(C("x"), "mean", 10)))


@query("ts_momentum", f"WITH {BARS_SQL} SELECT sym, d, round(CASE WHEN count(lr) OVER f >= 63 AND i > 126 THEN tanh(ln(lag(c, 5) OVER w / lag(c, 126) OVER w) / (stddev_samp(lr) OVER f * sqrt(252.0))) END, 6) AS v FROM rets WINDOW w AS (PARTITION BY sym ORDER BY d), f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)")
def ts_momentum(spark, d):
    w = W.series()
    return out(rets(spark, d), "sym", "d", v=F.when(C("i") > 126, F.tanh(F.log(F.lag("c", 5).over(w) / F.lag("c", 126).over(w)) / (W.rolling(C("lr"), "std", 63) * math.sqrt(252)))))


@query(
    "ou_mle_rolling",
    f"""WITH {BARS_SQL}, e AS (SELECT sym, d, ln(c) AS y, ln(lag(c) OVER (PARTITION BY sym ORDER BY d)) AS x FROM bars)
    SELECT sym, d, round(CASE WHEN count(x) OVER f >= 60 THEN regr_slope(y, x) OVER f END, 5) AS slope, round(CASE WHEN count(x) OVER f >= 60 AND regr_slope(y, x) OVER f BETWEEN 0.000001 AND 0.999999 THEN -ln(2.0) / ln(regr_slope(y, x) OVER f) END, 4) AS half_life
    FROM e WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)
def ou_rolling(spark, d):
    f = W.trailing(60)
    e = bars_1d(spark, d).withColumn("y", F.log("c")).withColumn("x", F.log(F.lag("c").over(W.series()))).withColumn("b", W.full(F.regr_slope("y", "x").over(f), C("x"), 60, f))
    return e.select("sym", "d", F.round("b", 5).alias("slope"), F.round(F.when(C("b").between(0.000001, 0.999999), -math.log(2) / F.log("b")), 4).alias("half_life"))


STATES = f"""{BARS_SQL}, sd AS (SELECT sym, d, i, CASE WHEN count(lr) OVER f >= 20 THEN stddev_samp(lr) OVER f END AS s FROM rets {RANGE}),
 q AS (SELECT sym, d, i, s, CASE WHEN count(s) OVER p >= 60 THEN quantile_cont(s, 0.33) OVER p END AS lo, CASE WHEN count(s) OVER p >= 60 THEN quantile_cont(s, 0.67) OVER p END AS hi FROM sd WINDOW p AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)),
 states AS (SELECT sym, d, i, CASE WHEN s <= lo THEN 'low' WHEN s <= hi THEN 'mid' ELSE 'high' END AS state FROM q WHERE lo IS NOT NULL AND s IS NOT NULL)"""


def states(spark, d) -> DataFrame:
    """Volatility states against terciles of the 120 rows before."""
    p = W.series().rowsBetween(-120, -1)
    s = rets(spark, d).withColumn("s", W.rolling(C("lr"), "std", 20))
    q = lambda x: F.when(F.count("s").over(p) >= 60, F.percentile("s", x).over(p))
    s = s.withColumn("lo", q(0.33)).withColumn("hi", q(0.67)).where("lo is not null and s is not null")
    return s.select("sym", "d", "i", "lr", F.when(C("s") <= C("lo"), "low").when(C("s") <= C("hi"), "mid").otherwise("high").alias("state"))


@query("vol_states", f"WITH {STATES} SELECT sym, d, state FROM states")
def vol_states(spark, d):
    return states(spark, d).select("sym", "d", "state")


@query("state_transitions", f"WITH {STATES}, p AS (SELECT state AS a, lead(state) OVER (PARTITION BY sym ORDER BY d) AS b FROM states) SELECT a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS p FROM p WHERE b IS NOT NULL GROUP BY a, b")
def transitions(spark, d):
    p = states(spark, d).select(C("state").alias("a"), F.lead("state").over(W.series()).alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    return p.select("a", "b", "n", F.round(C("n") / F.sum("n").over(Window.partitionBy("a")), 6).alias("p"))


@query(
    "state_episodes",
    f"""WITH {STATES}, c AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY sym ORDER BY d) THEN 0 ELSE 1 END AS ch FROM states), g AS (SELECT *, sum(ch) OVER (PARTITION BY sym ORDER BY d) AS run FROM c),
    k AS (SELECT sym, run, state, count(*) AS n FROM g GROUP BY 1, 2, 3) SELECT state, count(*) AS episodes, sum(n)::BIGINT AS rows, round(avg(n), 6) AS mean_length FROM k GROUP BY state""",
)
def episodes(spark, d):
    k = W.islands(states(spark, d), "state").groupBy("sym", "run", "state").agg(F.count("*").alias("n"))
    return k.groupBy("state").agg(F.count("*").alias("episodes"), F.sum("n").alias("rows"), F.round(F.avg("n"), 6).alias("mean_length"))


@query("carry_ranks", f"WITH {FUNDING_SQL}, m AS (SELECT sym, date_trunc('month', d)::DATE AS m, avg(rate) AS x FROM funding GROUP BY 1, 2) SELECT sym, m, round(x * 1e6, 7) AS carry, rank() OVER (PARTITION BY m ORDER BY x DESC) AS place FROM m")
def carry_ranks(spark, d):
    m = funding(spark, d).groupBy("sym", F.trunc("d", "month").alias("m")).agg(F.avg("rate").alias("x"))
    return m.select("sym", "m", F.round(C("x") * 1e6, 7).alias("carry"), F.rank().over(Window.partitionBy("m").orderBy(C("x").desc())).cast("long").alias("place"))
