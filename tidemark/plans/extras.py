"""Range proxies, weighted trends, phases, model fits of bounded stretches, further books and sinks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.shipping import ship
from tidemark.operators import sequential as S
from tidemark.operators import windows as W
from tidemark.plans.decisions import FILLS, SCOUT, fills, scout
from tidemark.plans.features import rets
from tidemark.plans.gates import features, returns
from tidemark.plans.panels import w
from tidemark.plans.registry import out, query
from tidemark.plans.research import WEIGHTS, inverse_vol
from tidemark.sources import store
from tidemark.sources.tables import BARS_SQL, SYMBOLS, bars_1d

C = F.col

_ln = lambda a, b: F.log(F.try_divide(C(a), C(b)))


@query("range_proxies", f"WITH {BARS_SQL} SELECT sym, d, round(lr * lr, 6) AS squared, round(ln(h / l) ** 2 / (4 * ln(2.0)), 6) AS parkinson, round(0.5 * ln(h / l) ** 2 - (2 * ln(2.0) - 1) * ln(c / o) ** 2, 6) AS garman_klass, round(ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o), 6) AS rogers_satchell FROM rets WHERE l > 0 AND h >= greatest(o, c) AND l <= least(o, c)")
def range_proxies(spark, d):
    """All estimates of a bar's variance side by side, of bars that keep the order of their prices."""
    b = rets(spark, d).where((C("l") > 0) & (C("h") >= F.greatest("o", "c")) & (C("l") <= F.least("o", "c")))
    return out(b, "sym", "d", squared=C("lr") ** 2, parkinson=_ln("h", "l") ** 2 / (4 * math.log(2)), garman_klass=0.5 * _ln("h", "l") ** 2 - (2 * math.log(2) - 1) * _ln("c", "o") ** 2, rogers_satchell=_ln("h", "c") * _ln("h", "o") + _ln("l", "c") * _ln("l", "o"))


WLS = f"{BARS_SQL}, y AS (SELECT sym, d, CAST(i AS DOUBLE) AS x, ln(c) AS p, vol AS v FROM rets), f AS (SELECT sym, d, x, p, count(*) OVER f AS n, sum(v) OVER f AS s, sum(v * x) OVER f / sum(v) OVER f AS mx, sum(v * p) OVER f / sum(v) OVER f AS mp, sum(v * x * x) OVER f / sum(v) OVER f AS xx, sum(v * x * p) OVER f / sum(v) OVER f AS xp FROM y {w(40)})"


@query("weighted_trend_residual", f"WITH {WLS} SELECT sym, d, round(p - mp - (xp - mx * mp) / (xx - mx * mx) * (x - mx), 5) AS v FROM f WHERE n >= 40")
def weighted_trend_residual(spark, d):
    """The log price against its trend over forty bars, weighted by volume."""
    f = W.trailing(40)
    y = rets(spark, d).select("sym", "d", C("i").cast("double").alias("x"), F.log("c").alias("p"), C("vol").alias("v"))
    s = F.sum("v").over(f)
    m = lambda e: F.sum(C("v") * e).over(f) / s
    y = y.withColumn("n", F.count("*").over(f)).withColumn("mx", m(C("x"))).withColumn("mp", m(C("p"))).withColumn("xx", m(C("x") * C("x"))).withColumn("xp", m(C("x") * C("p"))).where("n >= 40")
    return out(y, "sym", "d", digits=5, v=C("p") - C("mp") - (C("xp") - C("mx") * C("mp")) / (C("xx") - C("mx") ** 2) * (C("x") - C("mx")))


@query("ffd_threshold", f"WITH {BARS_SQL}, e AS (SELECT sym, d, stddev_samp(lr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS s, count(lr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS n FROM rets) SELECT sym, round(greatest(1e-5, least(1e-3, 1e-4 * quantile_cont(s, 0.5) / max_by(s, d))) * 1e6, 4) AS threshold FROM e WHERE n >= 50 GROUP BY sym")
def ffd_threshold(spark, d):
    """The cut of differencing weights, in millionths: tighter where the last volatility is above its median, within bounds."""
    f = W.trailing(100)
    e = rets(spark, d).withColumn("s", F.stddev_samp("lr").over(f)).withColumn("n", F.count("lr").over(f)).where("n >= 50")
    return e.groupBy("sym").agg(F.round(F.greatest(F.lit(1e-5), F.least(F.lit(1e-3), 1e-4 * F.try_divide(F.percentile("s", 0.5), F.max_by("s", "d")))) * 1e6, 4).alias("threshold"))


def phase(values: np.ndarray) -> np.ndarray:
    """Of each row the angle of its analytic signal at the end, behind its mean and a Hann window; as a share of pi."""
    n = values.shape[1]
    x = (values - values.mean(1, keepdims=True)) * np.hanning(n)
    f = np.fft.fft(x, axis=1)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    z = np.fft.ifft(f * gain, axis=1)
    return np.angle(z[:, -2]) / np.pi


@query("hilbert_phase")
def hilbert_phase(spark, d):
    """Over windows of 64 closes, which travel as arrays of their frame: rows are independent."""
    ship(spark)
    b = bars_1d(spark, d).select("sym", "d", F.collect_list("c").over(W.trailing(64)).alias("a")).where(F.size("a") >= 64)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a = np.array(batch.column("a").to_pylist(), float)
                yield pa.record_batch([batch.column("sym"), batch.column("d"), pa.array(np.round(phase(a), 6))], ["sym", "d", "phase"])

    return b.mapInArrow(run, "sym string, d date, phase double")


@query("macro_features", f"WITH {BARS_SQL}, p AS (SELECT d, max(CASE WHEN sym = 'AF' THEN c END) AS a, max(CASE WHEN sym = 'RO' THEN c END) AS b, max(CASE WHEN sym = 'NO' THEN c END) AS x FROM bars GROUP BY d), s AS (SELECT d, a - b AS spread, a / nullif(x, 0) AS ratio, x FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND x IS NOT NULL) SELECT d, round(spread, 6) AS spread, round(ratio, 6) AS ratio, round(CASE WHEN count(*) OVER f >= 60 THEN (x - avg(x) OVER f) / nullif(stddev_samp(x) OVER f, 0) END, 5) AS z FROM s WINDOW f AS (ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def macro_features(spark, d):
    """A spread, a ratio and a deviation over sixty days of three macro series: one row a day."""
    pick = lambda s: F.max(F.when(C("sym") == s, C("c")))
    p = bars_1d(spark, d).groupBy("d").agg(pick("AF").alias("a"), pick("RO").alias("b"), pick("NO").alias("x")).dropna()
    f = Window.orderBy("d").rowsBetween(-59, 0)
    z = F.when(F.count("*").over(f) >= 60, F.try_divide(C("x") - F.avg("x").over(f), F.stddev_samp("x").over(f)))
    return p.select("d", F.round(C("a") - C("b"), 6).alias("spread"), F.round(F.try_divide("a", "x"), 6).alias("ratio"), F.round(z, 5).alias("z"))


# Model fits: a bounded stretch of each series, one task a series

STRETCH = 1000


def fitted(spark, d, fit, schema: str) -> DataFrame:
    """fit(returns of the first STRETCH bars) for each series: a dictionary of numbers."""
    import pandas as pd

    ship(spark)
    x = rets(spark, d).where(f"r is not null and i <= {STRETCH}").select("sym", "i", "lr")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"sym": frame.sym.iloc[0], **fit(frame.sort_values("i").lr.to_numpy())}])

    return x.groupBy("sym").applyInPandas(run, schema)


def garch(x: np.ndarray) -> dict:
    """The best of a grid of (alpha, beta) with the long-run variance fixed to the sample's, by the normal likelihood."""
    x = x - x.mean()
    v0 = x.var()
    best = (-np.inf, 0.0, 0.0, v0)
    for alpha in np.arange(0.02, 0.32, 0.04):
        for beta in np.arange(0.5, 0.98 - alpha, 0.06):
            v, total = v0, 0.0
            for e in x:
                total -= 0.5 * (math.log(v) + e * e / v)
                v = (1 - alpha - beta) * v0 + alpha * e * e + beta * v
            best = max(best, (total, float(alpha), float(beta), float(v)))
    return {"alpha": round(best[1], 4), "beta": round(best[2], 4), "forecast": round(best[3], 6)}


def hidden_fit(x: np.ndarray, rounds: int = 25) -> dict:
    """Deviations and the chance to stay of a two-state normal model, by forward-backward rounds."""
    sd, stay = np.array([0.5, 1.5]) * x.std(), 0.95
    for _ in range(rounds):
        like = np.exp(-0.5 * (x[:, None] / sd) ** 2) / sd + 1e-300
        move = np.array([[stay, 1 - stay], [1 - stay, stay]])
        a, b = np.empty_like(like), np.ones_like(like)
        a[0] = like[0] / like[0].sum()
        for t in range(1, len(x)):
            a[t] = (a[t - 1] @ move) * like[t]
            a[t] /= a[t].sum()
        for t in range(len(x) - 2, -1, -1):
            b[t] = move @ (like[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        g = a * b
        g /= g.sum(1, keepdims=True)
        pair = a[:-1, :, None] * move * (like[1:] * b[1:])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        stay = float(np.clip((pair[:, 0, 0] + pair[:, 1, 1]).sum() / len(pair), 0.5, 0.999))
        sd = np.sqrt((g * x[:, None] ** 2).sum(0) / g.sum(0))
    low, high = sorted(float(v) for v in sd)
    return {"low": round(low, 6), "high": round(high, 6), "stay": round(stay, 6)}


@query("garch_fit")
def garch_fit(spark, d):
    return fitted(spark, d, garch, "sym string, alpha double, beta double, forecast double")


@query("hidden_state_fit")
def hidden_state_fit(spark, d):
    return fitted(spark, d, hidden_fit, "sym string, low double, high double, stay double")


@query("principal_components")
def principal_components(spark, d):
    """Loadings of three features, fitted on training bars: ranks would need one pass a feature, plain correlations come from one."""
    x = features(spark, d).where("i <= 1000")
    names = ["a", "b", "e"]
    row = x.agg(*(F.corr(p, q).alias(f"{p}{q}") for p in names for q in names)).first()
    m = np.array([row[f"{p}{q}"] if row[f"{p}{q}"] is not None else float(p == q) for p in names for q in names], float).reshape(3, 3)
    values, vectors = np.linalg.eigh(m)
    rows = [(k, n, round(float(abs(vectors[i, 2 - k])), 5), round(float(values[2 - k] / 3), 5)) for k in range(3) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "component int, feature string, loading double, share double")


# Books


@query("barrier_book", f"WITH {SCOUT}, bk AS (SELECT sc.d, least(0.25, 0.05 / (0.05 + abs(fl.ret))) * (sc.side * fl.ret - 0.0021) AS x FROM sc JOIN fl USING (sym, d)) SELECT d, count(*) AS n, round(avg(x), 6) AS pnl FROM bk GROUP BY d")
def barrier_book(spark, d):
    """The scout's trades through their barriers, sized and net of a round trip, by day of entry."""
    t = scout(spark, d).join(fills(spark, d).select("sym", "d", "ret"), ["sym", "d"])
    t = t.withColumn("x", F.least(F.lit(0.25), 0.05 / (0.05 + F.abs("ret"))) * (C("side") * C("ret") - 0.0021))
    return t.groupBy("d").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("pnl"))


@query("baseline_tracks", f"WITH {WEIGHTS}, n AS (SELECT sym, d, r, w, 1.0 / count(*) OVER (PARTITION BY d) AS e, i FROM (SELECT sym, d, i FROM rets) JOIN w USING (sym, d)), h AS (SELECT sym, d, r, i, lag(w) OVER o AS w, lag(e) OVER o AS e FROM n WINDOW o AS (PARTITION BY sym ORDER BY d)), t AS (SELECT 'inverse_vol' AS track, d, sum(w * r) AS x FROM h WHERE i > 400 AND r IS NOT NULL GROUP BY d UNION ALL SELECT 'equal', d, sum(e * r) FROM h WHERE i > 400 AND r IS NOT NULL GROUP BY d) SELECT track, count(*) AS days, round(avg(x) / stddev_samp(x) * sqrt(252.0), 5) AS sharpe FROM t GROUP BY track")
def baseline_tracks(spark, d):
    """Two fixed ways to weigh, on the bars that are out of sample."""
    o = W.series()
    h = inverse_vol(spark, d).withColumn("e", 1.0 / F.count("*").over(W.cross())).withColumn("h", F.lag("w").over(o)).withColumn("g", F.lag("e").over(o)).where("i > 400 and r is not null")
    rows = F.array(F.struct(F.lit("inverse_vol").alias("track"), (C("h") * C("r")).alias("x")), F.struct(F.lit("equal").alias("track"), (C("g") * C("r")).alias("x")))
    t = h.select("d", F.inline(rows)).groupBy("track", "d").agg(F.sum("x").alias("x"))
    return t.groupBy("track").agg(F.count("*").alias("days"), F.round(F.avg("x") / F.stddev_samp("x") * math.sqrt(252), 5).alias("sharpe"))


def levered_step(leverage: float, floor: float, rate: float):
    """Carry with borrowed money: financing every bar, scaled down by halving until the margin holds: (time, scale, equity)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, r = row
        if r is not None:
            s["equity"] *= max(0.0, 1 + s["scale"] * r * 0.01 - (s["scale"] - 1) * rate)
        low, high = 0.0, leverage
        for _ in range(30):  # the largest scale whose loss of one move like the worst so far leaves the floor
            mid = (low + high) / 2
            low, high = (mid, high) if 1 - mid * s["worst"] >= floor else (low, mid)
        s["scale"] = low
        if r is not None:
            s["worst"] = max(s["worst"], -r * 0.01, 0.01)
        return [(at, s["scale"], s["equity"])]

    return lambda: {"equity": 1.0, "scale": 1.0, "worst": 0.05}, step


@query("levered_book")
def levered_book(spark, d):
    x = rets(spark, d).select("sym", C("i").cast("long").alias("i"), "r")
    k = S.fold(x, "sym", ["i"], ["i", "r"], *levered_step(10.0, 0.5, 0.0001), "sym string, at long, scale double, equity double", ["sym", "at", "scale", "equity"], [pa.string(), pa.int64(), pa.float64(), pa.float64()])
    return out(k, "sym", "at", scale=C("scale"), equity=C("equity"))


@query("trend_long_flat_book", f"WITH {BARS_SQL}, s AS (SELECT sym, d, r, CASE WHEN c > avg(c) OVER f THEN 1 ELSE 0 END AS p, 0.1 / nullif(stddev_samp(lr) OVER g, 0) AS k FROM rets WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), g AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), h AS (SELECT d, r, lag(p * least(1, coalesce(k, 0))) OVER (PARTITION BY sym ORDER BY d) AS w FROM s) SELECT d, round(avg(coalesce(w, 0) * r), 6) AS x FROM h WHERE r IS NOT NULL GROUP BY d")
def trend_long_flat(spark, d):
    """Long above the mean of fifty bars, scaled by volatility, else flat."""
    s = rets(spark, d).withColumn("w", F.when(C("c") > F.avg("c").over(W.trailing(50)), 1).otherwise(0) * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(0.1), F.stddev_samp("lr").over(W.trailing(20))), F.lit(0.0))))
    h = s.withColumn("h", F.coalesce(F.lag("w").over(W.series()), F.lit(0.0))).where("r is not null")
    return h.groupBy("d").agg(F.round(F.avg(C("h") * C("r")), 6).alias("x"))


@query("member_days", "WITH e AS (SELECT o_custkey % 50 AS k, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'F' THEN 'add' ELSE 'remove' END AS a, o_orderkey FROM orders), u AS (SELECT k, d, max_by(a, o_orderkey) AS a FROM e GROUP BY k, d), m AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1998-01-01', INTERVAL 1 MONTH))::DATE AS m), j AS (SELECT m.m, s.k, u.a FROM m CROSS JOIN (SELECT DISTINCT k FROM e) s ASOF LEFT JOIN u ON u.k = s.k AND m.m >= u.d) SELECT m, count_if(a = 'add') AS members FROM j GROUP BY m")
def member_days(spark, d):
    """Members at the start of each month, from events that add and remove them."""
    from tidemark.operators import timeline as T
    from tidemark.sources.tables import table

    e = table(spark, d, "orders").select((C("o_custkey") % 50).alias("k"), F.to_date("o_orderdate").alias("d"), F.when(C("o_orderstatus") == "F", "add").otherwise("remove").alias("a"), "o_orderkey")
    u = e.groupBy("k", "d").agg(F.max_by("a", "o_orderkey").alias("a"))
    months = spark.sql("select explode(sequence(date'1996-01-01', date'1998-01-01', interval 1 month)) as m")
    days = months.crossJoin(F.broadcast(e.select("k").distinct()))  # 25 months by 50 keys
    j = T.asof_join(days, u, "m", ["k"], ["a"], F.expr("interval 100000 days"), right_on="d")
    return j.groupBy("m").agg(F.count_if(C("a") == "add").alias("members"))


def write_market(df: DataFrame, path: str) -> None:
    """A validated sink: prices in order and unique keys, or nothing is written."""
    store.check(df, {"low": C("l") <= F.least("o", "c"), "high": C("h") >= F.greatest("o", "c"), "volume": C("vol") >= 0})
    if not df.groupBy("sym", "d").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise store.ContractError("repeated bars")
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy("sym").parquet(path)
