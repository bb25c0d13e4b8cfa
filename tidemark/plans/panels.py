"""Adaptive bars, further features of series and of the market, and statistics of groups."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import sequential as S
from tidemark.operators import timeline as T
from tidemark.operators import windows as W
from tidemark.plans.features import FFD, RANGE, STATES, folded, rets, states
from tidemark.plans.registry import out, query
from tidemark.plans.research import BOOK, book, equity, info_bars
from tidemark.plans.temporal import OI_SQL, open_interest
from tidemark.sources.tables import BARS_SQL, FUNDING_SQL, TICKS_SQL, bars_1d, funding, ticks

C = F.col


def w(n: int, x: str = "f") -> str:
    return f"WINDOW {x} AS (PARTITION BY sym ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# Thresholds that follow the hour of the week

HOURS_SQL = f"""{TICKS_SQL}, h AS (SELECT sym, date_trunc('hour', ts) AS ts, sum(price * qty) AS notional, abs(sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END)) AS imbalance,
 greatest(sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END), sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END)) AS runs FROM ticks GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY sym, (isodow(ts) - 1) * 24 + hour(ts) ORDER BY ts) AS j, (isodow(ts) - 1) * 24 + hour(ts) AS bucket, epoch(ts) / 3600.0 AS t FROM h)"""


def hours(spark, d) -> DataFrame:
    buy, sell = (F.sum(F.when(C("side") == s, C("qty")).otherwise(0.0)) for s in ("buy", "sell"))
    h = ticks(spark, d).groupBy("sym", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    h = h.agg(F.sum(C("price") * C("qty")).alias("notional"), F.abs(buy - sell).alias("imbalance"), F.greatest(buy, sell).alias("runs"))
    h = h.withColumn("bucket", F.weekday("ts") * 24 + F.hour("ts")).withColumn("t", F.unix_timestamp(C("ts").cast("timestamp")) / 3600.0)
    return h.withColumn("j", F.row_number().over(Window.partitionBy("sym", "bucket").orderBy("ts")))


def seasonal(h: DataFrame, x: str, by_time: bool) -> DataFrame:
    """Adds v: the decayed mean of the same hour of the weeks before (half as much four weeks on), by place or by the time between.

    Weights relative to the bucket's first row: one running sum, no row of a bucket is held.
    """
    bucket = Window.partitionBy("sym", "bucket")
    age = (C("t") - F.min("t").over(bucket)) / 672.0 if by_time else C("j") / 4.0
    before = bucket.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.pow(F.lit(2.0), age)
    h = h.withColumn("_w", weight)
    return h.withColumn("v", F.sum(C("_w") * C(x)).over(before) / F.sum("_w").over(before)).drop("_w")


def _threshold(name: str, x: str, by_time: bool, per_day: float, default: float):
    """Seasonal level per bar; before the second week the median day's so far, else the default."""
    age = "(b.t - k.t) / 672.0" if by_time else "(b.j - k.j) / 4.0"
    sql = f"""WITH {HOURS_SQL}, s AS (SELECT k.sym, k.ts, sum(pow(2.0, {age}) * b.{x}) / sum(pow(2.0, {age})) AS v FROM k LEFT JOIN k b ON b.sym = k.sym AND b.bucket = k.bucket AND b.ts < k.ts GROUP BY k.sym, k.ts),
    y AS (SELECT sym, CAST(ts AS DATE) AS d, sum({x}) AS x FROM h GROUP BY ALL), m AS (SELECT sym, d, quantile_cont(x, 0.5) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) / 24 AS m FROM y)
    SELECT s.sym, s.ts, round(coalesce(s.v, m.m, {default} * {per_day} / 24) * 24 / {per_day}, 4) AS v FROM s LEFT JOIN m ON m.sym = s.sym AND m.d = CAST(s.ts AS DATE)"""

    @query(name, sql)
    def run(spark, d):
        return out(threshold(spark, d, x, by_time, per_day, default), "sym", "ts", digits=4, v=C("v"))


def threshold(spark, d, x: str, by_time: bool, per_day: float, default: float) -> DataFrame:
    h = hours(spark, d)
    days = h.groupBy("sym", F.to_date("ts").alias("day")).agg(F.sum(x).alias("x"))
    before = Window.partitionBy("sym").orderBy("day").rowsBetween(-7, -1)
    days = days.select("sym", "day", (F.percentile("x", 0.5).over(before) / 24).alias("m"))
    s = seasonal(h, x, by_time).withColumn("day", F.to_date("ts")).join(days, ["sym", "day"], "left")
    return s.select("sym", "ts", (F.coalesce("v", "m", F.lit(default * per_day / 24)) * 24 / per_day).alias("v"))


_threshold("dollar_thresholds", "notional", False, 10.0, 1e6)
_threshold("imbalance_thresholds", "imbalance", True, 10.0, 50.0)
_threshold("runs_thresholds", "runs", False, 10.0, 100.0)


def _adaptive(name: str, kind: str, x: str, by_time: bool, default: float):
    @query(name)
    def run(spark, d):
        """Ticks with the threshold of their hour, stepped through in order."""
        t = ticks(spark, d).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")).withColumn("sign", F.when(C("side") == "buy", 1).otherwise(-1))
        limits = threshold(spark, d, x, by_time, 10.0, default).select("sym", C("ts").alias("hour"), C("v").alias("threshold"))
        return info_bars(t.join(limits, ["sym", "hour"]), S.adaptive_step(kind), ["price", "qty", "sign", "threshold"])


_adaptive("dollar_bars_adaptive", "dollar", "notional", False, 1e6)
_adaptive("imbalance_bars_adaptive", "imbalance", "imbalance", True, 50.0)
_adaptive("runs_bars_adaptive", "runs", "runs", False, 100.0)


@query(
    "asset_market_features",
    f"""WITH {TICKS_SQL}, a AS (SELECT sym, time_bucket(INTERVAL 8 HOUR, ts) AS ts, avg(price) AS x FROM ticks GROUP BY ALL), g AS (SELECT s.sym, t.ts, a.x FROM (SELECT DISTINCT sym FROM a) s CROSS JOIN (SELECT DISTINCT ts FROM a) t LEFT JOIN a ON a.sym = s.sym AND a.ts = t.ts),
    f AS (SELECT sym, ts, last_value(x IGNORE NULLS) OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x FROM g)
    SELECT ts, round(avg(x), 6) AS mean, round(max(CASE WHEN sym = 'view' THEN x END) - avg(CASE WHEN sym <> 'view' THEN x END), 6) AS spread, round(stddev_pop(x), 6) AS dispersion FROM f GROUP BY ts""",
)
def asset_market(spark, d):
    """Means of eight hours on the common grid, carried over three holes at most: the market's mean, one asset against the others, dispersion."""
    a = ticks(spark, d).groupBy("sym", F.window("ts", "8 hours")["start"].cast("timestamp_ntz").alias("ts")).agg(F.avg("price").alias("x"))
    times = a.select("ts").distinct()
    names = a.select("sym").distinct().agg(F.collect_list("sym").alias("names"))  # a few assets
    g = times.crossJoin(F.broadcast(names)).select("ts", F.explode("names").alias("sym")).join(a, ["sym", "ts"], "left")
    f = T.fill_forward(g, ["x"], "sym", "ts", 3)
    alts = F.avg(F.when(C("sym") != "view", C("x")))
    f = f.groupBy("ts").agg(F.avg("x").alias("m"), (F.max(F.when(C("sym") == "view", C("x"))) - alts).alias("s"), F.stddev_pop("x").alias("p"))
    return out(f, "ts", mean=C("m"), spread=C("s"), dispersion=C("p"))


TRADES = f"{BARS_SQL}, tr AS (SELECT sym, i AS a, i + 5 + i % 7 AS z, CASE WHEN r > 0 THEN -1 ELSE 1 END AS side FROM rets WHERE abs(r) > 0.9)"


def mean_trades(spark, d) -> DataFrame:
    """Trades against large moves: the bars behind their entry up to their exit."""
    e = rets(spark, d).where("abs(r) > 0.9").select("sym", C("i").alias("a"), (C("i") + 5 + C("i") % 7).alias("z"), F.when(C("r") > 0, -1).otherwise(1).alias("side"))
    return e


@query("trades_mark_to_market", f"WITH {TRADES}, x AS (SELECT sym, unnest(generate_series(a + 1, z)) AS i, side FROM tr), n AS (SELECT sym, i, sum(side) AS net, count(*) AS open FROM x GROUP BY ALL) SELECT n.sym, CAST(n.i AS BIGINT) AS at, CAST(net AS BIGINT) AS net, open, round(0.1 * net * r, 6) AS pnl FROM n JOIN rets USING (sym, i)")
def mark_to_market(spark, d):
    """Open trades bar by bar: net side, how many are open, what the bar makes."""
    x = mean_trades(spark, d).select("sym", "side", F.explode(F.sequence(C("a") + 1, C("z"))).alias("i")).groupBy("sym", "i").agg(F.sum("side").alias("net"), F.count("*").alias("open"))
    return x.join(rets(spark, d).select("sym", "i", "r"), ["sym", "i"]).select("sym", C("i").cast("long").alias("at"), "net", "open", F.round(0.1 * C("net") * C("r"), 6).alias("pnl"))


@query("trades_annualised_sharpe", f"WITH {TRADES}, p AS (SELECT t.sym, e.d, t.side * (e.c / s.c - 1) AS r FROM tr t JOIN rets s ON s.sym = t.sym AND s.i = t.a JOIN rets e ON e.sym = t.sym AND e.i = t.z), g AS (SELECT sym, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM p GROUP BY sym), y AS (SELECT g.sym, g.d, coalesce(sum(r), 0) AS r FROM g LEFT JOIN p USING (sym, d) GROUP BY ALL) SELECT sym, count(*) AS days, round(avg(r) / stddev_samp(r) * sqrt(365.25), 5) AS sharpe FROM y GROUP BY sym")
def trades_sharpe(spark, d):
    """Trades' returns by day of exit, on the full calendar."""
    b = rets(spark, d).select("sym", "i", "d", "c")
    p = mean_trades(spark, d).join(b.select("sym", C("i").alias("a"), C("c").alias("c0")), ["sym", "a"]).join(b.select("sym", C("i").alias("z"), "d", "c"), ["sym", "z"])
    p = p.groupBy("sym", "d").agg(F.sum(C("side") * (C("c") / C("c0") - 1)).alias("r"))
    y = T.spine(p, "sym", "d").withColumn("d", F.to_date("d")).join(p, ["sym", "d"], "left").fillna(0.0, ["r"])
    return y.groupBy("sym").agg(F.count("*").alias("days"), F.round(F.try_divide(F.avg("r"), F.stddev_samp("r")) * math.sqrt(365.25), 5).alias("sharpe"))


# Rolling and expanding features


def _feature(name: str, ctes: str, value: str, frame: str, make, digits: int = 6):
    @query(name, f"WITH {ctes} SELECT sym, d, round({value}, {digits}) AS v FROM x {frame}")
    def run(spark, d):
        df, v = make(spark, d)
        return out(df, "sym", "d", digits=digits, v=v)


RETS = f"{BARS_SQL}, x AS (SELECT * FROM rets)"
EXPANDING = "WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
least = lambda value, x, n, frame: F.when(F.count(x).over(frame) >= n, value)
_feature("expanding_std", RETS, "CASE WHEN count(lr) OVER f >= 30 THEN stddev_samp(lr) OVER f END", EXPANDING, lambda s, d: (rets(s, d), least(F.stddev_samp("lr").over(W.expanding()), "lr", 30, W.expanding())))
_feature("expanding_volatility", RETS, "CASE WHEN count(lr) OVER f >= 60 THEN stddev_samp(lr) OVER f * sqrt(365.0) END", EXPANDING, lambda s, d: (rets(s, d), least(F.stddev_samp("lr").over(W.expanding()) * math.sqrt(365), "lr", 60, W.expanding())))
_feature(
    "rolling_cvar_60", f"{BARS_SQL}, g AS (SELECT *, quantile_cont(lr, 0.1) OVER f AS cut, list(lr) OVER f AS a, count(lr) OVER f AS k FROM rets {w(60)}), x AS (SELECT sym, d, CASE WHEN k >= 60 THEN -list_avg(list_filter(a, lambda e: e <= cut)) END AS y FROM g)", "y", "",
    lambda s, d: (rets(s, d).withColumn("q", F.percentile("lr", 0.1).over(W.trailing(60))).withColumn("a", F.collect_list("lr").over(W.trailing(60))).withColumn("low", F.filter("a", lambda y: y <= C("q"))), F.when(F.size("a") >= 60, -F.aggregate("low", F.lit(0.0), lambda p, y: p + y) / F.size("low"))),
)
_feature(
    "cycle_phase", f"{BARS_SQL}, y AS (SELECT *, c - lag(c) OVER (PARTITION BY sym ORDER BY d) AS s FROM bars), x AS (SELECT sym, d, count(s) OVER f AS n, (s - avg(s) OVER f) / nullif(stddev_pop(s) OVER f, 0) AS zs, (c - avg(c) OVER f) / nullif(stddev_pop(c) OVER f, 0) AS zc FROM y {w(30)})", "CASE WHEN n >= 30 THEN atan2(zs, zc) / pi() END", "",
    lambda s, d: ((b := bars_1d(s, d).withColumn("s", C("c") - F.lag("c").over(W.series()))), least(F.atan2(F.try_divide(C("s") - F.avg("s").over(f := W.trailing(30)), F.stddev_pop("s").over(f)), F.try_divide(C("c") - F.avg("c").over(f), F.stddev_pop("c").over(f))) / math.pi, "s", 30, W.trailing(30))), 5,
)
_feature(
    "shannon_entropy", f"{BARS_SQL}, y AS (SELECT sym, d, list(lr) OVER f AS a, count(lr) OVER f AS n, min(lr) OVER f AS lo, max(lr) OVER f AS hi FROM rets {w(64)}), z AS (SELECT sym, d, n, unnest(list_transform(a, lambda v: least(7, floor((v - lo) / nullif(hi - lo, 0) * 8)))) AS bin FROM y WHERE n >= 64), p AS (SELECT sym, d, bin, count(*) / any_value(n) AS p FROM z GROUP BY sym, d, bin), x AS (SELECT sym, d, -sum(p * log2(p)) / 3 AS y FROM p GROUP BY sym, d)", "y", "",
    lambda s, d: entropy(s, d),
)


def entropy(spark, d):
    """Of eight bins between the extremes of 64 returns, as a share of the greatest possible."""
    f = W.trailing(64)
    x = rets(spark, d).select("sym", "d", F.collect_list("lr").over(f).alias("a")).where(F.size("a") >= 64).withColumn("lo", F.array_min("a")).withColumn("hi", F.array_max("a"))
    bins = F.transform("a", lambda v: F.least(F.lit(7), F.floor(F.try_divide(v - C("lo"), C("hi") - C("lo")) * 8)))
    shares = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.size(F.filter("b", lambda y: y == k)) / F.size("b"))
    total = F.aggregate(F.transform("p", lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)), F.lit(0.0), lambda t, v: t + v)
    return x.withColumn("b", bins).withColumn("p", shares), total / 3


_feature(
    "ffd_log_volume", f"{BARS_SQL}, x AS (SELECT sym, d, " + " + ".join(f"({v!r}) * ln(1 + lag(vol, {k}) OVER (PARTITION BY sym ORDER BY d))" for k, v in enumerate(FFD)) + " AS y FROM bars)", "y", "",
    lambda s, d: (bars_1d(s, d), sum((v * F.log1p(F.lag("vol", k).over(W.series()) if k else C("vol")) for k, v in enumerate(FFD)), F.lit(0.0))),
)
_feature(
    "stationarity_z", f"{BARS_SQL}, y AS (SELECT sym, d, ln(c) AS p FROM bars), z AS (SELECT sym, d, p, avg(p) OVER f AS m, (p - avg(p) OVER f) / nullif(stddev_samp(p) OVER f, 0) AS zp, count(*) OVER f AS n FROM y {w(40)}), x AS (SELECT sym, d, count(*) OVER (PARTITION BY sym ORDER BY d) AS k, zp, (m - avg(m) OVER f) / nullif(stddev_samp(m) OVER f, 0) AS zm FROM z {w(40)})", "CASE WHEN k >= 80 THEN greatest(-4, least(4, zp - zm)) END", "",
    lambda s, d: stationarity(s, d), 5,
)


def stationarity(spark, d):
    """Deviation of the log price from its mean against that of its mean, both in deviations; behind twice the window."""
    f = W.trailing(40)
    z = lambda x: F.try_divide(C(x) - F.avg(x).over(f), F.stddev_samp(x).over(f))
    b = bars_1d(spark, d).withColumn("p", F.log("c")).withColumn("m", F.avg("p").over(f)).withColumn("k", F.row_number().over(W.series()))
    return b, F.when(C("k") >= 80, F.greatest(F.lit(-4.0), F.least(F.lit(4.0), z("p") - z("m"))))


LAGS = (2, 4, 8, 16)
_feature(
    "hurst_100", f"{BARS_SQL}, y AS (SELECT sym, d, " + ", ".join(f"ln(c) - lag(ln(c), {k}) OVER (PARTITION BY sym ORDER BY d) AS s{k}" for k in LAGS) + f" FROM bars), z AS (SELECT sym, d, count(s16) OVER f AS n, " + ", ".join(f"ln(sqrt(avg(s{k} * s{k}) OVER f)) AS q{k}" for k in LAGS) + f" FROM y {w(100)}), x AS (SELECT sym, d, n, (" + " + ".join(f"({math.log(k) - math.log(2) * 2.5!r}) * q{k}" for k in LAGS) + f") / {5 * math.log(2) ** 2!r} AS y FROM z)", "CASE WHEN n >= 100 THEN y END", "",
    lambda s, d: hurst(s, d), 5,
)


def hurst(spark, d):
    """Slope of the log of root mean squares of differences over the log of their lags, in closed form for lags of powers of two."""
    f = W.trailing(100)
    b = bars_1d(spark, d)
    for k in LAGS:
        b = b.withColumn(f"s{k}", F.log("c") - F.lag(F.log("c"), k).over(W.series()))
    slope = sum(((math.log(k) - 2.5 * math.log(2)) * F.log(F.sqrt(F.avg(C(f"s{k}") ** 2).over(f))) for k in LAGS), F.lit(0.0)) / (5 * math.log(2) ** 2)
    return b, least(slope, "s16", 100, f)


_feature("realized_variance", f"{TICKS_SQL}, p AS (SELECT sym, CAST(ts AS DATE) AS d, ln(price / nullif(lag(nullif(price, 0)) OVER (PARTITION BY sym, CAST(ts AS DATE) ORDER BY ts, seq), 0)) AS lr, price FROM ticks WHERE price > 0), x AS (SELECT sym, d, sum(lr * lr) AS y FROM p GROUP BY sym, d)", "y", "", lambda s, d: realized(s, d), 5)


def realized(spark, d):
    """Squared log returns between a day's ticks, summed up."""
    t = ticks(spark, d).where("price > 0").withColumn("d", F.to_date("ts"))
    t = t.withColumn("lr", F.log(C("price") / F.lag("price").over(Window.partitionBy("sym", "d").orderBy("ts", "seq"))))
    return t.groupBy("sym", "d").agg(F.sum(C("lr") ** 2).alias("y")), C("y")


_feature(
    "robust_scale_60", RETS, "CASE WHEN count(lr) OVER f >= 60 THEN (lr - quantile_cont(lr, 0.5) OVER f) / nullif(quantile_cont(lr, 0.75) OVER f - quantile_cont(lr, 0.25) OVER f, 0) END", w(60),
    lambda s, d: (rets(s, d), least(F.try_divide(C("lr") - F.percentile("lr", 0.5).over(f := W.trailing(60)), F.percentile("lr", 0.75).over(f) - F.percentile("lr", 0.25).over(f)), "lr", 60, W.trailing(60))), 5,
)
_feature("rolling_percent_rank", f"{BARS_SQL}, y AS (SELECT sym, d, c, list(c) OVER f AS a FROM bars {w(60)}), x AS (SELECT sym, d, CASE WHEN len(a) >= 60 THEN len(list_filter(a, lambda v: v <= c)) / len(a) END AS y FROM y)", "y", "", lambda s, d: (bars_1d(s, d).withColumn("a", F.collect_list("c").over(W.trailing(60))), F.when(F.size("a") >= 60, F.size(F.filter("a", lambda v: v <= C("c"))) / F.size("a"))))

_feature(
    "spearman_autocorr_40", f"{BARS_SQL}, y AS (SELECT sym, d, lr, lag(lr) OVER (PARTITION BY sym ORDER BY d) AS pr FROM rets), g AS (SELECT sym, d, count(pr) OVER f AS n, list({{'a': lr, 'b': pr}}) FILTER (pr IS NOT NULL) OVER f AS s FROM y {w(40)}), u AS (SELECT sym, d, unnest(s) AS e, s FROM g WHERE n >= 40), k AS (SELECT sym, d, len(list_filter(s, lambda v: v.a < e.a)) + (len(list_filter(s, lambda v: v.a = e.a)) + 1) / 2.0 AS ra, len(list_filter(s, lambda v: v.b < e.b)) + (len(list_filter(s, lambda v: v.b = e.b)) + 1) / 2.0 AS rb FROM u), x AS (SELECT sym, d, corr(ra, rb) AS y FROM k GROUP BY sym, d)", "y", "",
    lambda s, d: spearman(s, d), 5,
)


def spearman(spark, d):
    """Correlation of average ranks of 40 pairs of neighbouring returns, within the frame's array."""
    f = W.trailing(40)
    e = rets(spark, d).withColumn("pr", F.lag("lr").over(W.series()))
    e = e.select("sym", "d", F.collect_list(F.when(C("pr").isNotNull(), F.struct(C("lr").alias("a"), C("pr").alias("b")))).over(f).alias("s")).where(F.size("s") >= 40)
    rank = lambda x: F.transform("s", lambda e: F.size(F.filter("s", lambda v: v[x] < e[x])) + (F.size(F.filter("s", lambda v: v[x] == e[x])) + 1) / 2.0)
    e = e.withColumn("ra", rank("a")).withColumn("rb", rank("b"))
    mid = (F.size("s") + 1) / 2.0
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: (u - mid) * (v - mid)), F.lit(0.0), lambda t, v: t + v)
    return e, F.try_divide(dot("ra", "rb"), F.sqrt(dot("ra", "ra") * dot("rb", "rb")))


# Weighted over all rows so far


def decayed(df: DataFrame, adjust: bool = False, **means: tuple[str, float]) -> DataFrame:
    """df (sym, i, ...) with exponentially weighted means over all rows so far, name=(column, alpha): one pass for all of them."""
    steps = [S.ewm_step(alpha, adjust) for _, alpha in means.values()]

    def step(s: dict, row: tuple) -> list[tuple]:
        at, *xs = row
        return [(at, *(one(s[k], (at, x))[0][1] for k, ((_, one), x) in enumerate(zip(steps, xs, strict=True))))]

    names = [f"_{n}" for n in means]
    x = df.select("sym", C("i").cast("long").alias("i"), *(C(c).alias(n) for n, (c, _) in zip(names, means.values(), strict=True)))
    schema = "sym string, i long, " + ", ".join(f"{n} double" for n in means)
    done = S.fold(x, "sym", ["i"], ["i", *names], lambda: {k: start() for k, (start, _) in enumerate(steps)}, step, schema, ["sym", "i", *means], [pa.string(), pa.int64(), *[pa.float64()] * len(means)])
    return df.join(done.withColumn("i", C("i").cast("int")), ["sym", "i"])


def ewm_sql(name: str, x: str, alpha: float, src: str = "rets", adjust: bool = False) -> str:
    seed = "1.0" if adjust else f"CASE WHEN b.i = m.i0 THEN 1.0 ELSE {alpha} END"
    return f"""{name} AS (SELECT m.sym, m.i, sum(pow({1 - alpha}, m.i - b.i) * {seed} * b.x) / sum(pow({1 - alpha}, m.i - b.i) * {seed}) AS v FROM (SELECT sym, i, min(CASE WHEN {x} IS NOT NULL THEN i END) OVER (PARTITION BY sym) AS i0 FROM {src}) m
     JOIN (SELECT sym, i, {x} AS x FROM {src} WHERE {x} IS NOT NULL) b ON b.sym = m.sym AND b.i <= m.i GROUP BY m.sym, m.i)"""


@query("ewma_spread", f"WITH {BARS_SQL}, {ewm_sql('a', 'ln(c)', 2 / 11)}, {ewm_sql('b', 'ln(c)', 2 / 41)} SELECT r.sym, r.d, round(a.v - b.v, 6) AS v FROM rets r JOIN a USING (sym, i) JOIN b USING (sym, i)")
def ewma_spread(spark, d):
    """The log price's mean over spans of 10 and 40, fast less slow."""
    b = rets(spark, d).withColumn("p", F.log("c")).select("sym", "i", "d", "p")
    b = decayed(b, fast=("p", 2 / 11), slow=("p", 2 / 41))
    return out(b, "sym", "d", v=C("fast") - C("slow"))


@query("ew_cvd", f"WITH {BARS_SQL} SELECT m.sym, CAST(m.i AS BIGINT) AS at, round(sum(pow(2.0, -(m.i - b.i) / 20.0) * (b.buy - b.sell)), 4) AS v FROM rets m JOIN rets b ON b.sym = m.sym AND b.i <= m.i GROUP BY m.sym, m.i")
def ew_cvd(spark, d):
    """Signed volume, half as heavy 20 bars on; not divided by the weights."""
    b = rets(spark, d).withColumn("x", C("buy") - C("sell"))
    k = 2.0 ** (-1 / 20)
    start, step = lambda: {"y": 0.0}, lambda s, row: [(row[0], s.update(y=s["y"] * k + row[1]) or s["y"])]
    done = S.fold(b.select("sym", C("i").cast("long").alias("i"), "x"), "sym", ["i"], ["i", "x"], start, step, "sym string, at long, v double", ["sym", "at", "v"], [pa.string(), pa.int64(), pa.float64()])
    return out(done, "sym", "at", digits=4, v=C("v"))


@query("ew_covariance", f"WITH {BARS_SQL}, p AS (SELECT a.d, a.sym AS x, b.sym AS y, a.r AS u, b.r AS v, row_number() OVER (PARTITION BY a.sym, b.sym ORDER BY a.d) AS i FROM rets a JOIN rets b ON a.d = b.d AND a.sym <= b.sym WHERE a.r IS NOT NULL AND b.r IS NOT NULL), n AS (SELECT x, y, max(i) AS n FROM p GROUP BY x, y) SELECT p.x, p.y, round(sum(pow(0.97, n - i) * u * v) / sum(pow(0.97, n - i)), 6) AS cov FROM p JOIN n ON p.x = n.x AND p.y = n.y GROUP BY p.x, p.y")
def ew_covariance(spark, d):
    """The latest exponentially weighted covariance of each pair, by the sum of the weights."""
    a = rets(spark, d).where("r is not null").select("sym", "d", "r")
    day = a.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("sym", "r"))).alias("s"))  # a few symbols a day
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y["sym"] >= x["sym"]), lambda y: F.struct(x["sym"].alias("x"), y["sym"].alias("y"), (x["r"] * y["r"]).alias("uv")))))
    p = day.select("d", F.explode(pairs).alias("p")).select("d", "p.*")
    age = F.row_number().over(Window.partitionBy("x", "y").orderBy(F.desc("d"))) - 1
    p = p.withColumn("w", F.pow(F.lit(0.97), age))
    return p.groupBy("x", "y").agg(F.round(F.sum(C("w") * C("uv")) / F.sum("w"), 6).alias("cov"))


@query("vol_zscore_causal", f"WITH {BARS_SQL}, {ewm_sql('e', 'lr * lr', 0.06, adjust=True)}, l AS (SELECT e.sym, e.i, ln(sqrt(e.v)) AS x FROM e WHERE e.i > 21 AND e.v > 0) SELECT sym, CAST(i AS BIGINT) AS at, round(CASE WHEN count(x) OVER f >= 30 AND stddev_samp(x) OVER f > 0 THEN (x - avg(x) OVER f) / stddev_samp(x) OVER f END, 5) AS v FROM l WINDOW f AS (PARTITION BY sym ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def vol_zscore(spark, d):
    """The log of the weighted volatility against its own history."""
    e = decayed(rets(spark, d).withColumn("q", C("lr") ** 2).select("sym", "i", "q"), True, v=("q", 0.06)).where("i > 21 and v > 0")
    e = e.withColumn("x", F.log(F.sqrt("v")))
    return out(e.withColumn("at", C("i").cast("long")), "sym", "at", digits=5, v=W.zscore_expanding(C("x"), 30, order="i"))


@query(
    "regime_features",
    f"""WITH {BARS_SQL}, {ewm_sql('a', 'c', 2 / 51)}, {ewm_sql('b', 'c', 2 / 201)} SELECT r.sym, r.d, round(a.v / b.v - 1, 6) AS ratio, CASE WHEN a.v > b.v THEN 1 ELSE 0 END AS bull,
    round(stddev_samp(lr) OVER f24 / nullif(stddev_samp(lr) OVER f168, 0), 5) AS vol_ratio, round(c / lag(c, 24) OVER o - 1, 6) AS r24, round(c / lag(c, 168) OVER o - 1, 6) AS r168 FROM rets r JOIN a USING (sym, i) JOIN b USING (sym, i)
    WINDOW o AS (PARTITION BY r.sym ORDER BY r.d), f24 AS (PARTITION BY r.sym ORDER BY r.d ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), f168 AS (PARTITION BY r.sym ORDER BY r.d ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)""",
)
def regime_features(spark, d):
    b = rets(spark, d).select("sym", "i", "d", "c", "lr")
    b = decayed(b, fast=("c", 2 / 51), slow=("c", 2 / 201))
    o = W.series()
    b = b.withColumn("bull", (C("fast") > C("slow")).cast("int"))
    return b.select(
        "sym", "d", F.round(C("fast") / C("slow") - 1, 6).alias("ratio"), "bull", F.round(F.try_divide(F.stddev_samp("lr").over(W.trailing(24)), F.stddev_samp("lr").over(W.trailing(168))), 5).alias("vol_ratio"),
        F.round(C("c") / F.lag("c", 24).over(o) - 1, 6).alias("r24"), F.round(C("c") / F.lag("c", 168).over(o) - 1, 6).alias("r168"),
    )


# Funding and open interest

RATES = f"{FUNDING_SQL}, x AS (SELECT sym, d, sum(rate) * 1e6 AS rate FROM funding GROUP BY ALL)"


def rates(spark, d) -> DataFrame:
    return funding(spark, d).groupBy("sym", "d").agg((F.sum("rate") * 1e6).alias("rate"))


_feature("funding_mean_21", RATES, "CASE WHEN count(rate) OVER f >= 21 THEN avg(rate) OVER f END", w(21), lambda s, d: (rates(s, d), W.rolling(C("rate"), "mean", 21)), 6)
_feature("funding_zscore", RATES, "CASE WHEN count(rate) OVER f >= 30 AND stddev_samp(rate) OVER f > 0 THEN (rate - avg(rate) OVER f) / stddev_samp(rate) OVER f END", "WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", lambda s, d: (rates(s, d), W.zscore_expanding(C("rate"), 30)), 5)
_feature("oi_log_change", f"{OI_SQL}, x AS (SELECT * FROM oi)", "ln(oi / lag(oi, 7) OVER (PARTITION BY sym ORDER BY d))", "", lambda s, d: (open_interest(s, d), F.log(C("oi") / F.lag("oi", 7).over(W.series()))))


@query(
    "funding_features",
    f"""WITH {RATES}, l AS (SELECT sym, d, lag(rate) OVER (PARTITION BY sym ORDER BY d) AS x FROM x) SELECT sym, d, round(x, 6) AS rate, round(x * 3 * 365, 1) AS annual, round(sum(x) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS day,
    round(CASE WHEN stddev_pop(x) OVER f > 0 THEN greatest(-6, least(6, (x - avg(x) OVER f) / stddev_pop(x) OVER f)) END, 5) AS z, sign(x)::INT AS side FROM l WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def funding_features(spark, d):
    x = rates(spark, d).withColumn("x", F.lag("rate").over(W.series()))
    f = W.trailing(30)
    z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (C("x") - F.avg("x").over(f)) / F.stddev_pop("x").over(f)))
    return x.select("sym", "d", F.round("x", 6).alias("rate"), F.round(C("x") * 3 * 365, 1).alias("annual"), F.round(F.sum("x").over(W.trailing(3)), 6).alias("day"), F.round(F.when(F.stddev_pop("x").over(f) > 0, z), 5).alias("z"), F.signum("x").cast("int").alias("side"))


@query(
    "oi_features",
    f"""WITH {BARS_SQL}, {OI_SQL}, j AS (SELECT b.sym, b.d, b.c, oi.oi FROM bars b ASOF LEFT JOIN oi ON b.sym = oi.sym AND b.d >= oi.d), l AS (SELECT sym, d, lag(oi) OVER w AS x, lag(oi, 2) OVER w AS px, c / lag(c) OVER w - 1 AS r FROM j WINDOW w AS (PARTITION BY sym ORDER BY d))
    SELECT sym, d, round(CASE WHEN stddev_pop(x) OVER f > 0 THEN (x - avg(x) OVER f) / stddev_pop(x) OVER f END, 5) AS z, round(ln(x / px), 6) AS change, CASE WHEN r > 0 AND x < px THEN -1 WHEN r < 0 AND x > px THEN 1 ELSE 0 END AS divergence FROM l WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def oi_features(spark, d):
    j = T.asof_join(bars_1d(spark, d).select("sym", "d", "c"), open_interest(spark, d), "d", ["sym"], ["oi"], F.expr("interval 100000 days"))
    o, f = W.series(), W.trailing(30)
    x = j.withColumn("x", F.lag("oi").over(o)).withColumn("px", F.lag("oi", 2).over(o)).withColumn("r", F.try_divide(C("c"), F.lag("c").over(o)) - 1)
    side = F.when((C("r") > 0) & (C("x") < C("px")), -1).when((C("r") < 0) & (C("x") > C("px")), 1).otherwise(0)
    return x.select("sym", "d", F.round(F.when(F.stddev_pop("x").over(f) > 0, (C("x") - F.avg("x").over(f)) / F.stddev_pop("x").over(f)), 5).alias("z"), F.round(F.log(C("x") / C("px")), 6).alias("change"), side.alias("divergence"))


# Regimes and the market


@query("structural_breaks")
def structural_breaks(spark, d):
    """Rows since the last break of the residuals of 60-bar trends: residual over its weighted deviation, summed on both sides."""
    f = W.trailing(60)
    b = rets(spark, d).withColumn("p", F.log("c")).withColumn("x", C("i").cast("double"))
    fit = F.regr_intercept("p", "x").over(f) + F.regr_slope("p", "x").over(f) * C("x")
    b = b.withColumn("e", least(C("p") - fit, "p", 60, f)).select("sym", "i", "e")
    b = decayed(b.withColumn("q", C("e") ** 2), True, v=("q", 0.06))
    b = b.withColumn("z", F.try_divide(C("e"), F.sqrt(F.greatest("v", F.lit(1e-8)))))
    return folded_long(b, S.break_step(5.0, 20), "z")


def folded_long(b: DataFrame, maker, x: str) -> DataFrame:
    start, step = maker
    done = S.fold(b.select("sym", C("i").cast("long").alias("i"), C(x).alias("x")), "sym", ["i"], ["i", "x"], start, step, "sym string, at long, since long", ["sym", "at", "since"], [pa.string(), pa.int64(), pa.int64()])
    return done


@query("supersmoother")
def supersmoother(spark, d):
    return folded(bars_1d(spark, d).withColumn("i", F.row_number().over(W.series())), S.smoother_step(10), "c")


@query(
    "regime_ids",
    f"""WITH {BARS_SQL}, v AS (SELECT sym, d, stddev_samp(lr) OVER f AS s, count(lr) OVER f AS n FROM rets {w(20)}), g AS (SELECT sym, d, lag(CASE WHEN n >= 20 THEN s END) OVER (PARTITION BY sym ORDER BY d) AS s FROM v),
    q AS (SELECT sym, d, s, count(s) OVER p AS n, quantile_cont(s, 0.33) OVER p AS lo, quantile_cont(s, 0.8) OVER p AS hi FROM g WINDOW p AS (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT sym, d, CASE WHEN n < 60 OR s IS NULL THEN NULL WHEN s > hi THEN 2 WHEN s > lo THEN 1 ELSE 0 END AS id FROM q""",
)
def regime_ids(spark, d):
    """Calm, normal, wild: yesterday's volatility against all that was known before."""
    return regimes(spark, d).select("sym", "d", "id")


def regimes(spark, d) -> DataFrame:
    g = rets(spark, d).withColumn("v", W.rolling(C("lr"), "std", 20)).withColumn("s", F.lag("v").over(W.series()))
    p = W.series().rowsBetween(Window.unboundedPreceding, -1)
    q = g.withColumn("n", F.count("s").over(p)).withColumn("lo", F.percentile("s", 0.33).over(p)).withColumn("hi", F.percentile("s", 0.8).over(p))
    return q.withColumn("id", F.when((C("n") < 60) | C("s").isNull(), None).when(C("s") > C("hi"), 2).when(C("s") > C("lo"), 1).otherwise(0))


@query("regime_soft")
def regime_soft(spark, d):
    """Weighted shares of each regime so far, which add up to one."""
    x = regimes(spark, d).where("id is not null").select("sym", "i", "d", *(F.when(C("id") == k, 1.0).otherwise(0.0).alias(f"x{k}") for k in range(3)))
    x = decayed(x, p0=("x0", 0.2), p1=("x1", 0.2), p2=("x2", 0.2))
    total = C("p0") + C("p1") + C("p2")
    return x.select("sym", "d", *(F.round(C(f"p{k}") / total, 6).alias(f"p{k}") for k in range(3)))


@query(
    "market_features",
    f"""WITH {BARS_SQL}, m AS (SELECT d, avg(lr) AS m FROM rets WHERE lr IS NOT NULL GROUP BY d), x AS (SELECT sym, d, lr, m, regr_slope(lr, m) OVER f AS b, regr_intercept(lr, m) OVER f AS a, count(lr) OVER f AS n, corr(lr, m) OVER f AS k FROM rets JOIN m USING (d) WHERE lr IS NOT NULL {w(60)}),
    e AS (SELECT *, lr - a - b * m AS e FROM x) SELECT sym, d, round(b, 5) AS beta, round(k, 5) AS corr, round(CASE WHEN stddev_samp(e) OVER f > 0 THEN e / stddev_samp(e) OVER f END, 4) AS z FROM e WHERE n >= 60 {w(60)}""",
)
def market_features(spark, d):
    """Each series against the market's mean return: slope, correlation and the residual in deviations over 60 bars. The mean stands for the first component, which it is close to for series of like scale."""
    r = rets(spark, d).where("lr is not null").select("sym", "d", "lr")
    m = r.groupBy("d").agg(F.avg("lr").alias("m"))
    f = W.trailing(60)
    x = r.join(m, "d").withColumn("b", F.regr_slope("lr", "m").over(f)).withColumn("a", F.regr_intercept("lr", "m").over(f)).withColumn("k", F.corr("lr", "m").over(f)).withColumn("n", F.count("lr").over(f)).where("n >= 60")
    x = x.withColumn("e", C("lr") - C("a") - C("b") * C("m"))
    return x.select("sym", "d", F.round("b", 5).alias("beta"), F.round("k", 5).alias("corr"), F.round(F.when(F.stddev_samp("e").over(f) > 0, C("e") / F.stddev_samp("e").over(f)), 4).alias("z"))


@query(
    "regime_masks",
    f"""WITH {BARS_SQL}, a AS (SELECT sym, d, c > avg(c) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS up, i, CASE WHEN count(lr) OVER f >= 30 THEN stddev_samp(lr) OVER f END AS v FROM rets {w(30)}),
    b AS (SELECT *, CASE WHEN count(v) OVER p >= 30 THEN v > quantile_cont(v, 0.5) OVER p END AS wild FROM a WINDOW p AS (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT sym, d, lag(CASE WHEN i >= 200 THEN up END) OVER o AS bull, lag(wild) OVER o AS wild FROM b WINDOW o AS (PARTITION BY sym ORDER BY d)""",
)
def regime_masks(spark, d):
    """Above the mean of 200 bars, more volatile than the median so far; both known the bar before."""
    return masks(spark, d).select("sym", "d", "bull", "wild")


def masks(spark, d) -> DataFrame:
    p, o = W.expanding(), W.series()
    a = rets(spark, d).withColumn("up", F.when(C("i") >= 200, C("c") > F.avg("c").over(W.trailing(200)))).withColumn("v", W.rolling(C("lr"), "std", 30))
    b = a.withColumn("loud", F.when(F.count("v").over(p) >= 30, C("v") > F.percentile("v", 0.5).over(p)))
    return b.withColumn("bull", F.lag("up").over(o)).withColumn("wild", F.lag("loud").over(o))


@query("book_features", f"WITH {BARS_SQL}, x AS (SELECT sym, d, (buy - sell) / nullif(buy + sell, 0) AS obi, (h - l) / nullif((h + l) / 2, 0) * 1e4 AS spread FROM bars) SELECT sym, d, round(avg(obi) OVER f, 6) AS obi, round(obi - lag(obi, 5) OVER (PARTITION BY sym ORDER BY d), 6) AS momentum, round(avg(spread) OVER f, 4) AS spread FROM x {w(10)}")
def book_features(spark, d):
    """Imbalance of both sides, its change and the spread in basis points, from arrays of levels: the two best of each side."""
    level = lambda p, q: F.array(F.struct(p.alias("price"), (q * 0.5).alias("size")), F.struct(p.alias("price"), (q * 0.5).alias("size")))
    b = bars_1d(spark, d).withColumn("bids", level(C("l"), C("buy"))).withColumn("asks", level(C("h"), C("sell")))
    size = lambda x: F.aggregate(F.slice(x, 1, 2), F.lit(0.0), lambda t, e: t + e["size"])
    b = b.withColumn("bid", size("bids")).withColumn("ask", size("asks")).withColumn("obi", F.try_divide(C("bid") - C("ask"), C("bid") + C("ask")))
    top, low = C("asks")[0]["price"], C("bids")[0]["price"]
    b = b.withColumn("spread", F.try_divide(top - low, (top + low) / 2) * 1e4)
    f = W.trailing(10)
    return b.select("sym", "d", F.round(F.avg("obi").over(f), 6).alias("obi"), F.round(C("obi") - F.lag("obi", 5).over(W.series()), 6).alias("momentum"), F.round(F.avg("spread").over(f), 4).alias("spread"))


@query("inverse_vol_legs", f"WITH {BARS_SQL}, s AS (SELECT sym, d, lr, CASE WHEN count(lr) OVER f >= 20 THEN stddev_samp(lr) OVER f END AS s FROM rets {w(20)}), k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY lr DESC, sym) AS k, count(*) OVER (PARTITION BY d) AS n FROM s WHERE s > 0), l AS (SELECT *, CASE WHEN k <= n // 2 THEN 1 WHEN k > n - n // 2 THEN -1 ELSE 0 END AS side FROM k) SELECT sym, d, round(CASE WHEN side = 0 THEN 0 ELSE side * 0.5 / s / sum(1 / s) OVER (PARTITION BY d, side) END, 6) AS w FROM l")
def inverse_vol_legs(spark, d):
    """The better and the worse half by score, each of gross one half, by inverse volatility."""
    s = rets(spark, d).withColumn("s", W.rolling(C("lr"), "std", 20)).where("s > 0")
    x = W.cross()
    s = s.withColumn("k", F.row_number().over(x.orderBy(C("lr").desc(), "sym"))).withColumn("h", F.floor(F.count("*").over(x) / 2)).withColumn("n", F.count("*").over(x))
    s = s.withColumn("side", F.when(C("k") <= C("h"), 1).when(C("k") > C("n") - C("h"), -1).otherwise(0))
    return out(s, "sym", "d", w=F.when(C("side") == 0, 0.0).otherwise(C("side") * 0.5 / C("s") / F.sum(1 / C("s")).over(Window.partitionBy("d", "side"))))


# Statistics of groups


def _stat(name: str, sql: str, run):
    query(name, sql)(run)


@query("calmar", f"WITH {BOOK} SELECT round(max_by(le, d) * 252.0 / count(*), 5) AS growth, round(ln(exp(max_by(le, d) * 252.0 / count(*)) - 1) - ln(max(drawdown)), 5) AS log_calmar FROM curve HAVING NOT bool_or(ruined)")
def calmar(spark, d):
    """Yearly growth over the deepest drawdown, as a log, for series that grow; none for a ruined book."""
    e = equity(book(spark, d)).agg(F.max_by("le", "d").alias("le"), F.count("*").alias("n"), F.max("drawdown").alias("dd"), F.max("ruined").alias("ruined")).where("not ruined")
    growth = C("le") * 252.0 / C("n")
    return e.select(F.round(growth, 5).alias("growth"), F.round(F.log(F.exp(growth) - 1) - F.log("dd"), 5).alias("log_calmar"))


@query("evt_var", f"WITH {BARS_SQL}, u AS (SELECT sym, quantile_cont(-r, 0.9) AS u, count(r) AS n FROM rets WHERE r IS NOT NULL GROUP BY sym), e AS (SELECT sym, any_value(u) AS u, any_value(u.n) AS n, count(*) AS k, avg(-r - u) AS m, var_samp(-r - u) AS v FROM rets JOIN u USING (sym) WHERE -r > u GROUP BY sym), p AS (SELECT *, 0.5 * (1 - m * m / v) AS xi, 0.5 * m * (m * m / v + 1) AS beta FROM e) SELECT sym, round(xi, 5) AS xi, round(u + beta / xi * (pow(n / k::DOUBLE * 0.01, -xi) - 1), 5) AS var99 FROM p")
def evt_var(spark, d):
    """Tail beyond the 90 % quantile of losses as a generalised Pareto law, fitted by its first two moments."""
    r = rets(spark, d).where("r is not null").withColumn("x", -C("r"))
    u = r.groupBy("sym").agg(F.percentile("x", 0.9).alias("u"), F.count("*").alias("n"))
    e = r.drop("n").join(u, "sym").where("x > u").groupBy("sym").agg(F.first("u").alias("u"), F.first("n").alias("n"), F.count("*").alias("k"), F.avg(C("x") - C("u")).alias("m"), F.var_samp(C("x") - C("u")).alias("v"))
    e = e.withColumn("xi", 0.5 * (1 - C("m") ** 2 / C("v"))).withColumn("beta", 0.5 * C("m") * (C("m") ** 2 / C("v") + 1))
    return e.select("sym", F.round("xi", 5).alias("xi"), F.round(C("u") + C("beta") / C("xi") * (F.pow(C("n") / C("k") * 0.01, -C("xi")) - 1), 5).alias("var99"))


@query("effective_breadth", f"WITH {BARS_SQL}, c AS (SELECT corr(a.r, b.r) AS k FROM rets a JOIN rets b ON a.d = b.d AND a.sym < b.sym WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.sym, b.sym), n AS (SELECT count(DISTINCT sym) AS n FROM bars) SELECT round(any_value(n) / (1 + (any_value(n) - 1) * avg(k)), 5) AS breadth FROM c, n")
def effective_breadth(spark, d):
    from tidemark.plans.research import correlations

    c = correlations_exact(spark, d, correlations)
    n = bars_1d(spark, d).agg(F.countDistinct("sym").alias("n"))
    return c.agg(F.avg("k").alias("k")).crossJoin(n).select(F.round(C("n") / (1 + (C("n") - 1) * C("k")), 5).alias("breadth"))  # one row by one row


def correlations_exact(spark, d, _=None) -> DataFrame:
    """Correlations of all pairs from each day's few symbols."""
    day = rets(spark, d).where("r is not null").groupBy("d").agg(F.sort_array(F.collect_list(F.struct("sym", "r"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y["sym"] > x["sym"]), lambda y: F.struct(x["sym"].alias("x"), y["sym"].alias("y"), x["r"].alias("u"), y["r"].alias("v")))))
    return day.select(F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(F.corr("p.u", "p.v").alias("k"))


@query("events_per_week", f"WITH {BARS_SQL} SELECT sym, round(count_if(abs(r) > 0.5) / ((max(d) - min(d)) / 7.0), 6) AS rate FROM rets GROUP BY sym")
def events_per_week(spark, d):
    return rets(spark, d).groupBy("sym").agg(F.round(F.count_if(F.abs("r") > 0.5) / (F.datediff(F.max("d"), F.min("d")) / 7.0), 6).alias("rate"))


@query("positive_ratio", "SELECT quality, count(*) AS n, round(avg(toxic), 6) AS positive FROM labels GROUP BY quality")
def positive_ratio(spark, d):
    from tidemark.sources.tables import table

    return table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 6).alias("positive"))


@query("state_diagnosis", f"WITH {STATES}, x AS (SELECT s.state, lead(r.r) OVER (PARTITION BY s.sym ORDER BY s.d) AS f FROM states s JOIN rets r USING (sym, d)) SELECT state, count(f) AS n, round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS vol, round(avg(f) - 1.96 * stddev_samp(f) / sqrt(count(f)), 6) AS low, round(avg(f) + 1.96 * stddev_samp(f) / sqrt(count(f)), 6) AS high FROM x GROUP BY state")
def state_diagnosis(spark, d):
    """What followed each state, with intervals."""
    x = states(spark, d).join(rets(spark, d).select("sym", "d", "r"), ["sym", "d"]).withColumn("f", F.lead("r").over(W.series()))
    m, s, n = F.avg("f"), F.stddev_samp("f"), F.count("f")
    return x.groupBy("state").agg(n.alias("n"), F.round(m, 6).alias("mean"), F.round(s, 6).alias("vol"), F.round(m - 1.96 * s / F.sqrt(n), 6).alias("low"), F.round(m + 1.96 * s / F.sqrt(n), 6).alias("high"))


@query("timeout_fraction", f"WITH {BARS_SQL}, j AS (SELECT a.sym, a.i, max(CASE WHEN b.h >= a.c * 1.2 OR b.l <= a.c * 0.8 THEN 1 ELSE 0 END) AS hit FROM rets a JOIN rets b ON a.sym = b.sym AND b.i > a.i AND b.i <= a.i + 5 GROUP BY a.sym, a.i) SELECT sym, round(avg(1 - hit), 6) AS timeout FROM j GROUP BY sym")
def timeout_fraction(spark, d):
    """Share of events that reach their horizon untouched."""
    f = W.series().rowsBetween(1, 5)
    j = bars_1d(spark, d).withColumn("up", F.max("h").over(f)).withColumn("down", F.min("l").over(f)).where("up is not null")
    return j.groupBy("sym").agg(F.round(F.avg(F.when((C("up") >= C("c") * 1.2) | (C("down") <= C("c") * 0.8), 0).otherwise(1)), 6).alias("timeout"))


@query("regime_breakdown", f"WITH {BARS_SQL}, a AS (SELECT sym, d, r, c > avg(c) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS up, i FROM rets), m AS (SELECT r, lag(CASE WHEN i >= 200 THEN up END) OVER (PARTITION BY sym ORDER BY d) AS bull FROM a) SELECT bull, count(r) AS n, round(avg(r) / stddev_samp(r) * sqrt(252.0), 5) AS sharpe FROM m WHERE bull IS NOT NULL GROUP BY bull")
def regime_breakdown(spark, d):
    return masks(spark, d).where("bull is not null").groupBy("bull").agg(F.count("r").alias("n"), F.round(F.avg("r") / F.stddev_samp("r") * math.sqrt(252), 5).alias("sharpe"))


@query("trial_count", "SELECT o_orderpriority AS hypothesis, CAST(sum(1 + o_custkey % 5) AS BIGINT) AS trials FROM orders GROUP BY 1")
def trial_count(spark, d):
    """Trials over a ledger's entries."""
    from tidemark.sources.tables import table

    return table(spark, d, "orders").groupBy(C("o_orderpriority").alias("hypothesis")).agg(F.sum(1 + C("o_custkey") % 5).alias("trials"))


@query("current_drawdown_252", f"WITH {BOOK} SELECT d, round(CASE WHEN ruined THEN 1 ELSE 1 - exp(le - max(le) OVER f) END, 5) + 0.0 AS drawdown FROM eq WINDOW f AS (ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)")
def current_drawdown(spark, d):
    """Against the peak of the last 252 days. One row a day: a book's days are few."""
    e = equity(book(spark, d)).select("d", "le", "ruined")
    f = Window.orderBy("d").rowsBetween(-251, 0)
    return e.select("d", (F.round(F.when(C("ruined"), 1.0).otherwise(1 - F.exp(C("le") - F.max("le").over(f))), 5) + 0.0).alias("drawdown"))
