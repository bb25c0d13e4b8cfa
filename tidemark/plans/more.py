"""Further features, risk rules and inference."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.shipping import ship
from tidemark.operators import windows as W
from tidemark.plans.features import STATES, TRUE_RANGE, rets, states, true_range
from tidemark.plans.registry import out, query
from tidemark.plans.research import BOOK, PAIR, SIGNAL, WEIGHTS, book, equity, halves, inverse_vol, signal
from tidemark.sources.tables import BARS_SQL, FUNDING_SQL, bars_1d, funding, table

C = F.col
W20 = "WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
W60 = "WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query("efficiency_ratio", f"WITH {BARS_SQL}, e AS (SELECT sym, d, abs(c - lag(c, 20) OVER w) AS net, abs(c - lag(c) OVER w) AS step FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)) SELECT sym, d, round(net / sum(step) OVER f, 6) AS v FROM e {W20}")
def efficiency(spark, d):
    w = W.series()
    e = bars_1d(spark, d).withColumn("net", F.abs(C("c") - F.lag("c", 20).over(w))).withColumn("step", F.abs(C("c") - F.lag("c").over(w)))
    return out(e, "sym", "d", v=C("net") / F.sum("step").over(W.trailing(20)))


@query("range_position", f"WITH {BARS_SQL} SELECT sym, d, round((c - min(l) OVER f) / nullif(max(h) OVER f - min(l) OVER f, 0), 6) AS v FROM bars {W20}")
def range_position(spark, d):
    f = W.trailing(20)
    span = F.max("h").over(f) - F.min("l").over(f)
    return out(bars_1d(spark, d), "sym", "d", v=F.when(span != 0, (C("c") - F.min("l").over(f)) / span))


@query("bollinger_z", f"WITH {BARS_SQL} SELECT sym, d, round(CASE WHEN count(c) OVER f >= 20 AND stddev_pop(c) OVER f > 0 THEN (c - avg(c) OVER f) / stddev_pop(c) OVER f END, 6) AS v FROM bars {W20}")
def bollinger(spark, d):
    f = W.trailing(20)
    sd = F.stddev_pop("c").over(f)
    return out(bars_1d(spark, d), "sym", "d", v=F.when((F.count("c").over(f) >= 20) & (sd > 0), (C("c") - F.avg("c").over(f)) / sd))


@query("volume_delta_z", f"WITH {BARS_SQL} SELECT sym, d, round(CASE WHEN count(buy) OVER f >= 60 AND stddev_samp(buy - sell) OVER f > 0 THEN (buy - sell - avg(buy - sell) OVER f) / stddev_samp(buy - sell) OVER f END, 6) AS v FROM bars {W60}")
def volume_delta(spark, d):
    f, x = W.trailing(60), C("buy") - C("sell")
    sd = F.stddev_samp(x).over(f)
    return out(bars_1d(spark, d), "sym", "d", v=F.when((F.count(x).over(f) >= 60) & (sd > 0), (x - F.avg(x).over(f)) / sd))


@query("run_bursts", f"WITH {BARS_SQL}, e AS (SELECT sym, d, CASE WHEN abs(buy - sell) > 0.5 * vol THEN 1 ELSE 0 END AS b, abs(buy - sell) AS x FROM bars) SELECT sym, d, sum(b) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS bursts, round(avg(x) OVER f, 6) AS level FROM e {W20}")
def bursts(spark, d):
    x = F.abs(C("buy") - C("sell"))
    return bars_1d(spark, d).select("sym", "d", F.sum(F.when(x > 0.5 * C("vol"), 1).otherwise(0)).over(W.trailing(5)).alias("bursts"), F.round(F.avg(x).over(W.trailing(20)), 6).alias("level"))


@query("causal_atr_buckets", f"""WITH {BARS_SQL}, t AS (SELECT sym, d, {TRUE_RANGE} / c AS tr FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)), a AS (SELECT sym, d, avg(tr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS s, avg(tr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS l FROM t)
    SELECT sym, d, CASE WHEN s < 0.95 * l THEN 'LOW' WHEN s > 1.05 * l THEN 'HIGH' ELSE 'NORMAL' END AS bucket FROM a""")
def atr_buckets(spark, d):
    t = bars_1d(spark, d).withColumn("tr", true_range() / C("c"))
    s, long = F.avg("tr").over(W.trailing(14)), F.avg("tr").over(W.trailing(100))
    return t.select("sym", "d", F.when(s < 0.95 * long, "LOW").when(s > 1.05 * long, "HIGH").otherwise("NORMAL").alias("bucket"))


@query("ols_residual", f"WITH {BARS_SQL}, e AS (SELECT sym, d, ln(c) AS y, CAST(i AS DOUBLE) AS i FROM rets) SELECT sym, d, round(CASE WHEN count(y) OVER f >= 60 THEN y - (regr_intercept(y, i) OVER f + regr_slope(y, i) OVER f * i) END, 5) AS v FROM e {W60}")
def ols_residual(spark, d):
    f = W.trailing(60)
    e = rets(spark, d).select("sym", "d", F.log("c").alias("y"), C("i").cast("double").alias("i"))
    return out(e, "sym", "d", digits=5, v=W.full(C("y") - (F.regr_intercept("y", "i").over(f) + F.regr_slope("y", "i").over(f) * C("i")), C("y"), 60, f))


MARKET = f"{BARS_SQL}, k AS (SELECT sym, d, i, lr AS y, avg(lr) OVER (PARTITION BY d) AS x FROM rets)"


def market(spark, d) -> DataFrame:
    return rets(spark, d).select("sym", "d", "i", C("lr").alias("y"), F.avg("lr").over(W.cross()).alias("x"))


@query("rolling_beta", f"WITH {MARKET} SELECT sym, d, round(CASE WHEN count(y) OVER f >= 60 THEN regr_slope(y, x) OVER f END, 5) AS beta FROM k WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def rolling_beta(spark, d):
    """Known before the bar."""
    f = W.series().rowsBetween(-60, -1)
    return out(market(spark, d), "sym", "d", digits=5, beta=W.full(F.regr_slope("y", "x").over(f), C("y"), 60, f))


@query("factor_model", f"WITH {MARKET} SELECT sym, round(regr_slope(y, x), 5) AS beta, round(regr_r2(y, x), 5) AS r2, round(sqrt((1 - regr_r2(y, x)) * var_samp(y)), 5) AS idio FROM k WHERE y IS NOT NULL GROUP BY sym")
def factor_model(spark, d):
    k = market(spark, d).where("y is not null")
    return k.groupBy("sym").agg(F.round(F.regr_slope("y", "x"), 5).alias("beta"), F.round(F.regr_r2("y", "x"), 5).alias("r2"), F.round(F.sqrt((1 - F.regr_r2("y", "x")) * F.var_samp("y")), 5).alias("idio"))


@query("trend_score", f"""WITH {BARS_SQL}, s AS (SELECT sym, d, stddev_samp(lr) OVER f AS sd, ln(c / lag(c, 10) OVER w) / sqrt(10.0) AS a, ln(c / lag(c, 30) OVER w) / sqrt(30.0) AS b, i FROM rets WINDOW w AS (PARTITION BY sym ORDER BY d), f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT sym, d, round((greatest(-2, least(2, a / sd)) + greatest(-2, least(2, b / sd))) / 4, 6) + 0.0 AS v FROM s WHERE i > 30""")
def trend_score(spark, d):
    w = W.series()
    sd = F.stddev_samp("lr").over(W.trailing(20))
    z = lambda n: F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.log(C("c") / F.lag("c", n).over(w)) / math.sqrt(n) / sd))
    return out(rets(spark, d).withColumn("v", (z(10) + z(30)) / 4).where("i > 30"), "sym", "d", v=C("v"))


@query("rolling_var_causal", f"WITH {BARS_SQL} SELECT sym, d, round(CASE WHEN count(r) OVER f >= 60 THEN -quantile_cont(r, 0.05) OVER f END, 6) AS v FROM rets WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def rolling_var(spark, d):
    f = W.series().rowsBetween(-60, -1)
    return out(rets(spark, d), "sym", "d", v=W.full(-F.percentile("r", 0.05).over(f), C("r"), 60, f))


@query("percent_rank_30d", f"WITH {FUNDING_SQL} SELECT sym, d, seq, round(avg(CASE WHEN b <= rate THEN 1.0 ELSE 0 END), 6) AS v FROM (SELECT a.sym, a.d, a.seq, a.rate, b.rate AS b FROM funding a JOIN funding b ON a.sym = b.sym AND b.d BETWEEN a.d - 30 AND a.d) GROUP BY sym, d, seq")
def percent_rank(spark, d):
    return out(W.ranks_within(funding(spark, d), "rate", 30, ["seq"]), "sym", "d", "seq", v=C("most") / C("n"))


@query("har_components", f"WITH {BARS_SQL}, e AS (SELECT sym, d, i, lr * lr AS v FROM rets) SELECT sym, d, round(v * 1e4, 5) AS day, round(avg(v) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) * 1e4, 5) AS week, round(avg(v) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * 1e4, 5) AS month FROM e WHERE i > 1")
def har(spark, d):
    e = rets(spark, d).where("i > 1").withColumn("v", C("lr") ** 2 * 1e4)
    return out(e, "sym", "d", digits=5, day=C("v"), week=F.avg("v").over(W.trailing(7)), month=F.avg("v").over(W.trailing(30)))


# Risk


@query("vol_target", f"WITH {SIGNAL} SELECT sym, d, round(x * least(2, CASE WHEN sum(abs(x) * 0.02) OVER (PARTITION BY d) > 0 THEN 0.01 / sum(abs(x) * 0.02) OVER (PARTITION BY d) ELSE 0 END), 6) + 0.0 AS w FROM g")
def vol_target(spark, d):
    risk = F.sum(F.abs("x") * 0.02).over(W.cross())
    return out(signal(spark, d), "sym", "d", w=C("x") * F.least(F.lit(2.0), F.when(risk > 0, 0.01 / risk).otherwise(0.0)))


@query("cap_participation", f"WITH {SIGNAL}, v AS (SELECT sym, d, avg(notional) OVER f AS adv FROM bars {W20}) SELECT g.sym, g.d, round(sign(x) * least(abs(x), 0.05 * adv / 1e5), 6) + 0.0 AS w FROM g JOIN v ON g.sym = v.sym AND g.d = v.d")
def cap_participation(spark, d):
    v = bars_1d(spark, d).select("sym", "d", F.avg("notional").over(W.trailing(20)).alias("adv"))
    return out(signal(spark, d).join(v, ["sym", "d"]), "sym", "d", w=F.signum("x") * F.least(F.abs("x"), 0.05 * C("adv") / 1e5))


@query("degrossing_tiers", f"WITH {BOOK}, x AS (SELECT d, drawdown AS dd FROM curve) SELECT d, CASE WHEN dd >= 0.2 THEN 0.0 WHEN dd >= 0.1 THEN 0.5 WHEN dd >= 0.05 THEN 0.75 ELSE 1.0 END AS m FROM x WHERE abs(dd - 0.2) > 1e-9 AND abs(dd - 0.1) > 1e-9 AND abs(dd - 0.05) > 1e-9".replace("0.0 WHEN", "0.0::DOUBLE WHEN"))
def degrossing(spark, d):
    x = equity(book(spark, d))
    for level in (0.2, 0.1, 0.05):
        x = x.where(F.abs(C("drawdown") - level) > 1e-9)
    return x.select("d", F.when(C("drawdown") >= 0.2, 0.0).when(C("drawdown") >= 0.1, 0.5).when(C("drawdown") >= 0.05, 0.75).otherwise(1.0).alias("m"))


@query("position_limit_breaches", f"WITH {WEIGHTS} SELECT sym, d, round(w, 6) AS w FROM w WHERE w > 0.3500001")
def breaches(spark, d):
    return out(inverse_vol(spark, d).where("w > 0.3500001"), "sym", "d", w=C("w"))


@query("liquidity_var", f"WITH {BARS_SQL}, a AS (SELECT sym, avg(notional) AS adv, -quantile_cont(r, 0.05) AS v FROM rets GROUP BY sym) SELECT sym, round(1e6 / (0.1 * adv), 4) AS days, round(1e6 * (v + 0.0005 + 0.1 * sqrt(1e6 / adv) * 0.01), 2) AS lvar FROM a")
def liquidity_var(spark, d):
    a = rets(spark, d).groupBy("sym").agg(F.avg("notional").alias("adv"), (-F.percentile("r", 0.05)).alias("v"))
    return a.select("sym", F.round(1e6 / (0.1 * C("adv")), 4).alias("days"), F.round(1e6 * (C("v") + 0.0005 + 0.1 * F.sqrt(1e6 / C("adv")) * 0.01), 2).alias("lvar"))


@query("impact_gate", "SELECT l_orderkey, l_linenumber, 0.001 * l_discount > 1.5 * 0.5 * 0.02 * sqrt(l_quantity / 1e4) AS passes, round(least(0.1 * 1e4, 1e4 * power(0.001 * l_discount / (1.5 * 0.5 * 0.02), 2)), 6) AS largest FROM lineitem")
def impact_gate(spark, d):
    alpha = 0.001 * C("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (alpha > 1.5 * 0.5 * 0.02 * F.sqrt(C("l_quantity") / 1e4)).alias("passes"), F.round(F.least(F.lit(1000.0), 1e4 * F.pow(alpha / (1.5 * 0.5 * 0.02), 2)), 6).alias("largest"))


# Inference


@query("cornish_fisher_var", f"""WITH {BARS_SQL}, m AS (SELECT sym, avg(r) AS m, stddev_pop(r) AS s, (avg(r ** 3) - 3 * avg(r) * avg(r ** 2) + 2 * avg(r) ** 3) / stddev_pop(r) ** 3 AS g, kurtosis_pop(r) AS k FROM rets WHERE r IS NOT NULL GROUP BY sym), z AS (SELECT *, -1.6448536269514722 AS z FROM m)
    SELECT sym, round(-(m + s * (z + (z * z - 1) * g / 6 + (z ** 3 - 3 * z) * k / 24 - (2 * z ** 3 - 5 * z) * g * g / 36)), 4) AS v FROM z""")
def cornish_fisher(spark, d):
    z = -1.6448536269514722
    g, k = F.skewness("r"), F.kurtosis("r")
    q = z + (z * z - 1) * g / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * g * g / 36
    return rets(spark, d).where("r is not null").groupBy("sym").agg(F.round(-(F.avg("r") + F.stddev_pop("r") * q), 4).alias("v"))


LAGS = 5


@query("lo_sharpe", f"""WITH {BARS_SQL}, a AS (SELECT sym, r, {", ".join(f"lag(r, {k}) OVER w AS r{k}" for k in range(1, LAGS + 1))} FROM rets WHERE r IS NOT NULL WINDOW w AS (PARTITION BY sym ORDER BY d))
    SELECT sym, round(avg(r) / stddev_samp(r) * 252 / sqrt(252 + 2 * ({" + ".join(f"{252 - k} * corr(r, r{k})" for k in range(1, LAGS + 1))})), 4) AS sharpe FROM a GROUP BY sym""")
def lo_sharpe(spark, d):
    """Annualised with the autocorrelations of five lags."""
    w = W.series()
    a = rets(spark, d).where("r is not null").select("sym", "r", *(F.lag("r", k).over(w).alias(f"r{k}") for k in range(1, LAGS + 1)))
    scale = sum(((252 - k) * F.corr("r", f"r{k}") for k in range(1, LAGS + 1)), F.lit(0.0))
    return a.groupBy("sym").agg(F.round(F.avg("r") / F.stddev_samp("r") * 252 / F.sqrt(252 + 2 * scale), 4).alias("sharpe"))


@query("diebold_mariano", f"""WITH {BARS_SQL}, e AS (SELECT sym, i, lr * lr AS v, avg(lr * lr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a, avg(lr * lr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS b FROM rets),
    l AS (SELECT sym, (v - a) ** 2 - (v - b) ** 2 AS x FROM e WHERE i > 41) SELECT sym, count(*) AS n, round(avg(x) / sqrt(var_pop(x) / count(*)) * sqrt((count(*) - 1.0) / count(*)), 4) AS dm FROM l GROUP BY sym""")
def diebold_mariano(spark, d):
    f = lambda n: F.avg(C("lr") ** 2).over(W.series().rowsBetween(-n, -1))
    e = rets(spark, d).select("sym", "i", (C("lr") ** 2).alias("v"), f(10).alias("a"), f(40).alias("b")).where("i > 41")
    e = e.select("sym", ((C("v") - C("a")) ** 2 - (C("v") - C("b")) ** 2).alias("x"))
    n = F.count("*")
    return e.groupBy("sym").agg(n.alias("n"), F.round(F.avg("x") / F.sqrt(F.var_pop("x") / n) * F.sqrt((n - 1.0) / n), 4).alias("dm"))


HALF = list(combinations(range(6), 3))


@query("pbo_cscv", f"""WITH {BARS_SQL}, x AS (SELECT sym, CAST((i - 2) % 6 AS INT) AS b, r FROM rets WHERE r IS NOT NULL), m AS (SELECT sym, b, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM x GROUP BY 1, 2), k AS (SELECT * FROM (VALUES {", ".join(f"({j}, {sum(1 << b for b in c)})" for j, c in enumerate(HALF))}) v(split, mask)),
    g AS (SELECT split, sym, (mask >> b) & 1 AS part, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM m CROSS JOIN k GROUP BY 1, 2, 3), h AS (SELECT split, sym, part, (s / n) / sqrt((q - s * s / n) / (n - 1)) AS sr FROM g),
    z AS (SELECT a.split, a.sym, a.sr AS ins, b.sr AS oos FROM h a JOIN h b ON a.split = b.split AND a.sym = b.sym AND a.part = 1 AND b.part = 0), r AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY oos) AS place, row_number() OVER (PARTITION BY split ORDER BY ins DESC, sym) AS best, count(*) OVER (PARTITION BY split) AS n FROM z)
    SELECT count(*) AS splits, round(avg(CASE WHEN place / (n + 1.0) <= 0.5 THEN 1.0 ELSE 0 END), 6) AS pbo FROM r WHERE best = 1""")
def pbo(spark, d):
    """Combinatorially symmetric splits from counts, sums and squares of six blocks; the twenty splits are a fixed table."""
    x = rets(spark, d).where("r is not null").select("sym", ((C("i") - 2) % 6).cast("int").alias("b"), "r")
    m = x.groupBy("sym", "b").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(C("r") ** 2).alias("q"))
    k = F.explode(F.array(*(F.struct(F.lit(j).alias("split"), F.lit(sum(1 << b for b in c)).alias("mask")) for j, c in enumerate(HALF)))).alias("k")
    inside = F.expr("shiftright(mask, b) & 1") == 1
    part = lambda c, yes: F.sum(F.when(inside if yes else ~inside, C(c)))
    g = m.select("*", k).select("sym", "b", "n", "s", "q", "k.*").groupBy("split", "sym").agg(*(part(c, y).alias(f"{c}{int(y)}") for c in "nsq" for y in (True, False)))
    sr = lambda y: (C(f"s{y}") / C(f"n{y}")) / F.sqrt((C(f"q{y}") - C(f"s{y}") ** 2 / C(f"n{y}")) / (C(f"n{y}") - 1))
    p = Window.partitionBy("split")
    z = g.select("split", "sym", sr(1).alias("ins"), sr(0).alias("oos"))
    z = z.withColumn("place", F.rank().over(p.orderBy("oos"))).withColumn("best", F.row_number().over(p.orderBy(C("ins").desc(), "sym"))).withColumn("n", F.count("*").over(p)).where("best = 1")
    return z.agg(F.count("*").alias("splits"), F.round(F.avg((C("place") / (C("n") + 1.0) <= 0.5).cast("double")), 6).alias("pbo"))


@query("clustered_mean", f"WITH {BARS_SQL}, x AS (SELECT d, sum(r) AS s, count(r) AS n FROM rets WHERE r IS NOT NULL GROUP BY d), m AS (SELECT sum(s) / sum(n) AS m, sum(n) AS n FROM x) SELECT round(max(m), 6) AS mean, round(sqrt(sum((s - x.n * m) ** 2)) / max(m.n), 6) AS se FROM x CROSS JOIN m")
def clustered_mean(spark, d):
    """Pooled mean; errors clustered by day, from three sums."""
    x = rets(spark, d).where("r is not null").groupBy("d").agg(F.sum("r").alias("s"), F.count("r").alias("n"))
    a = x.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum(C("s") ** 2).alias("ss"), F.sum(C("s") * C("n")).alias("sn"), F.sum(C("n") ** 2).alias("nn"))
    m = C("s") / C("n")
    return a.select(F.round(m, 6).alias("mean"), F.round(F.sqrt(C("ss") - 2 * m * C("sn") + m * m * C("nn")) / C("n"), 6).alias("se"))


@query("state_agreement", f"WITH {STATES}, x AS (SELECT sym, d, state AS a, lag(state, 5) OVER (PARTITION BY sym ORDER BY d) AS b FROM states), y AS (SELECT * FROM x WHERE b IS NOT NULL), t AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po FROM y), pa AS (SELECT a, count(*) AS k FROM y GROUP BY a), pb AS (SELECT b, count(*) AS k FROM y GROUP BY b), e AS (SELECT sum(pa.k * pb.k) AS s FROM pa JOIN pb ON pa.a = pb.b) SELECT n, round(po, 6) AS same, round((po - s / n / n) / (1 - s / n / n), 6) AS kappa FROM t CROSS JOIN e")
def agreement(spark, d):
    y = states(spark, d).select(C("state").alias("a"), F.lag("state", 5).over(W.series()).alias("b")).where("b is not null")
    names = ("low", "mid", "high")
    t = y.agg(F.count("*").alias("n"), F.avg((C("a") == C("b")).cast("double")).alias("po"), *(F.count_if(C(c) == s).cast("double").alias(c + s) for c in "ab" for s in names))
    pe = sum((C("a" + s) * C("b" + s) for s in names), F.lit(0.0)) / C("n") / C("n")
    return t.select("n", F.round("po", 6).alias("same"), F.round((C("po") - pe) / (1 - pe), 6).alias("kappa"))


@query("cumulative_importance", f"WITH {BARS_SQL}, x AS (SELECT sym, sum(notional) AS v FROM bars GROUP BY sym), c AS (SELECT *, sum(v) OVER (ORDER BY v DESC, sym) / sum(v) OVER () AS share FROM x) SELECT sym, round(share, 6) AS share FROM c WHERE share - v / (SELECT sum(v) FROM x) < 0.8")
def cumulative(spark, d):
    """The leading features that make up the share; features are few, so one window."""
    x = bars_1d(spark, d).groupBy("sym").agg(F.sum("notional").alias("v"))
    everything = Window.orderBy(C("v").desc(), "sym")
    total = F.sum("v").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    c = x.withColumn("total", total).withColumn("share", F.sum("v").over(everything.rowsBetween(Window.unboundedPreceding, 0)) / C("total"))
    return c.where(C("share") - C("v") / C("total") < 0.8).select("sym", F.round("share", 6).alias("share"))


@query("reference_stability", f"WITH {PAIR} SELECT sym, round(avg(CASE WHEN old THEN r END) - avg(CASE WHEN NOT old THEN r END), 6) AS shift, round(stddev_samp(CASE WHEN old THEN r END) / stddev_samp(CASE WHEN NOT old THEN r END), 5) AS ratio FROM s GROUP BY sym")
def stability(spark, d):
    old, new = F.when(C("old"), C("r")), F.when(~C("old"), C("r"))
    return halves(spark, d).groupBy("sym").agg(F.round(F.avg(old) - F.avg(new), 6).alias("shift"), F.round(F.stddev_samp(old) / F.stddev_samp(new), 5).alias("ratio"))


def stationary_indices(n: int, mean_block: float, rng: np.random.Generator) -> np.ndarray:
    """Places of one replicate of the stationary bootstrap: blocks of geometric length from random starts, around the end."""
    opens = rng.random(n) < 1 / mean_block
    opens[0] = True
    starts = rng.integers(0, n, n)
    block = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    return (starts[block] + np.arange(n) - block) % n


@query("bootstrap_sharpe")
def bootstrap_sharpe(spark, d):
    """200 replicates of the book's yearly Sharpe ratio; replicates are dealt out with their seeds, the book's days are few and go along."""
    net = np.array([r["net"] for r in book(spark, d).orderBy("d").collect()])  # one row a day
    ship(spark)

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            values = []
            for i in ids:
                x = net[stationary_indices(len(net), 10, np.random.default_rng([7, i]))]
                values.append(float(x.mean() / x.std(ddof=1) * math.sqrt(252)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(values)], ["id", "sharpe"])

    reps = spark.range(200).mapInArrow(run, "id long, sharpe double")
    return reps.agg(*(F.round(F.percentile("sharpe", q), 4).alias(n) for n, q in (("low", 0.05), ("median", 0.5), ("high", 0.95))))


@query("minimum_variance")
def minimum_variance(spark, d):
    """Long-only weights of least variance over all symbols with returns, from the moments of each pair's common days (a matrix of their number squared), by projected gradient."""
    b = rets(spark, d).where("r is not null")
    names = sorted(r["sym"] for r in b.select("sym").distinct().collect())
    if not names:
        return spark.createDataFrame([], "sym string, w double")
    a = b.groupBy("d").pivot("sym", names).agg(F.max("r"))
    row = a.agg(*(F.covar_samp(x, y).alias(f"{x}{y}") for x in names for y in names)).first()
    n = len(names)
    cov = np.array([row[f"{x}{y}"] if row[f"{x}{y}"] is not None else float(x == y) for x in names for y in names], float).reshape(n, n)
    # Moments of different days need not fit together: the nearest matrix that is a covariance.
    values, vectors = np.linalg.eigh(cov)
    cov = (vectors * np.maximum(values, 0)) @ vectors.T
    w = np.full(n, 1 / n)
    for _ in range(5000):
        w = w - cov @ w / np.trace(cov)
        u = np.sort(w)[::-1]
        k = np.flatnonzero(u - (np.cumsum(u) - 1) / np.arange(1, n + 1) > 0)[-1]
        w = np.maximum(w - (np.cumsum(u)[k] - 1) / (k + 1), 0)
    return spark.createDataFrame([(n, round(float(x), 4)) for n, x in zip(names, w, strict=True)], "sym string, w double")
