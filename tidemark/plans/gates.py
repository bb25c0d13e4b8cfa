"""Inference and gates, books stepped through in order, live rules, and the points where users plug in their own."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.shipping import ship
from tidemark.operators import sequential as S
from tidemark.operators import windows as W
from tidemark.plans.features import rets
from tidemark.plans.panels import w
from tidemark.plans.registry import out, query
from tidemark.plans.research import PREDICTIONS, WEIGHTS, book, inverse_vol, predictions
from tidemark.sources.tables import BARS_SQL, FUNDING_SQL, TICKS_SQL, bars_1d, funding, table, ticks

C = F.col
RETS = f"{BARS_SQL}, x AS (SELECT sym, d, r, row_number() OVER (PARTITION BY sym ORDER BY d) AS k FROM rets WHERE r IS NOT NULL)"


def returns(spark, d) -> DataFrame:
    return rets(spark, d).where("r is not null").select("sym", "d", "r", F.row_number().over(W.series()).alias("k"))


# Inference


def lags_for(n: Column) -> Column:
    return F.floor(4 * F.pow(n / 100.0, F.lit(2 / 9)))


@query("hac_variance_ratio", f"WITH {RETS}, m AS (SELECT sym, avg(r) AS m, count(*) AS n, floor(4 * pow(count(*) / 100.0, 2.0 / 9)) AS q FROM x GROUP BY sym), z AS (SELECT x.sym, x.k, x.r - m.m AS e FROM x JOIN m USING (sym)), c AS (SELECT a.sym, a.k - b.k AS lag, sum(a.e * b.e) AS s FROM z a JOIN z b ON a.sym = b.sym AND b.k <= a.k AND b.k >= a.k - 20 GROUP BY ALL) SELECT m.sym, CAST(q AS BIGINT) AS lags, round(1 + 2 * sum(CASE WHEN lag BETWEEN 1 AND q THEN (1 - lag / (q + 1)) * s END) / max(CASE WHEN lag = 0 THEN s END), 5) AS ratio FROM c JOIN m USING (sym) GROUP BY m.sym, q")
def hac_variance_ratio(spark, d):
    """The long-run variance over the plain one, with Bartlett weights; lags by the usual rule from the number of rows."""
    x = returns(spark, d)
    m = x.groupBy("sym").agg(F.avg("r").alias("m"), F.count("*").alias("n")).withColumn("q", lags_for(C("n")))
    z = x.join(F.broadcast(m), "sym").withColumn("e", C("r") - C("m"))  # a row for each symbol
    sums = [F.sum(C("e") * C(f"e{k}")).alias(f"s{k}") for k in range(1, 21)]
    z = z.select("sym", "e", "q", *(F.lag("e", k).over(W.series()).alias(f"e{k}") for k in range(1, 21)))
    g = z.groupBy("sym", "q").agg(F.sum(C("e") ** 2).alias("s0"), *sums)
    part = sum((F.when(F.lit(k) <= C("q"), (1 - k / (C("q") + 1)) * C(f"s{k}")).otherwise(0.0) for k in range(1, 21)), F.lit(0.0))
    return g.select("sym", C("q").cast("long").alias("lags"), F.round(1 + 2 * part / C("s0"), 5).alias("ratio"))


@query("period_sharpe", f"WITH {RETS}, p AS (SELECT sym, date_trunc('month', d) AS m, exp(sum(ln(1 + r))) - 1 AS r FROM x WHERE r > -1 GROUP BY ALL) SELECT sym, count(*) AS n, round(avg(r) / stddev_samp(r) * sqrt(12.0), 5) AS sharpe FROM p GROUP BY sym HAVING count(*) >= 12")
def period_sharpe(spark, d):
    """From compounded monthly returns."""
    p = returns(spark, d).where("r > -1").groupBy("sym", F.trunc("d", "month").alias("m")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("r"))
    return p.groupBy("sym").agg(F.count("*").alias("n"), F.round(F.try_divide(F.avg("r"), F.stddev_samp("r")) * math.sqrt(12), 5).alias("sharpe")).where("n >= 12")


PAIRS = f"{RETS}, p AS (SELECT a.sym AS x, b.sym AS y, a.d, a.r AS u, b.r AS v FROM x a JOIN x b ON a.d = b.d AND a.sym < b.sym)"


def pairs(spark, d) -> DataFrame:
    """Common days of each pair of the day's few symbols."""
    day = returns(spark, d).groupBy("d").agg(F.sort_array(F.collect_list(F.struct("sym", "r"))).alias("s"))
    found = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y["sym"] > x["sym"]), lambda y: F.struct(x["sym"].alias("x"), y["sym"].alias("y"), x["r"].alias("u"), y["r"].alias("v")))))
    return day.select("d", F.explode(found).alias("p")).select("d", "p.*")


@query("jobson_korkie", f"WITH {PAIRS}, m AS (SELECT x, y, count(*) AS n, avg(u) / stddev_samp(u) AS a, avg(v) / stddev_samp(v) AS b, corr(u, v) AS k FROM p GROUP BY x, y) SELECT x, y, round((a - b) / sqrt((2 - 2 * k + 0.5 * (a * a + b * b - 2 * a * b * k * k)) / n), 5) AS z FROM m")
def jobson_korkie(spark, d):
    """The paired test of two Sharpe ratios with the later correction."""
    ratio = lambda x: F.avg(x) / F.stddev_samp(x)
    m = pairs(spark, d).groupBy("x", "y").agg(F.count("*").alias("n"), ratio("u").alias("a"), ratio("v").alias("b"), F.corr("u", "v").alias("k"))
    variance = (2 - 2 * C("k") + 0.5 * (C("a") ** 2 + C("b") ** 2 - 2 * C("a") * C("b") * C("k") ** 2)) / C("n")
    return m.select("x", "y", F.round((C("a") - C("b")) / F.sqrt(variance), 5).alias("z"))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return high


def expected_best(trials: int) -> float:
    """The expected maximum of so many standard normal numbers, by the usual approximation."""
    g = 0.5772156649015329
    return (1 - g) * normal_quantile(1 - 1 / trials) + g * normal_quantile(1 - 1 / (trials * math.e))


def deflated(sharpe: float, n: int, variance: float, skew: float, kurtosis: float, trials: int) -> float:
    """The chance that a Sharpe ratio (per period) is above what the best of so many trials has by luck."""
    luck = math.sqrt(variance) * expected_best(trials)
    scale = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    return normal_cdf((sharpe - luck) * math.sqrt(n - 1) / math.sqrt(scale)) if scale > 0 else float("nan")


def sharpe_moments(spark, d, period: str | None = None) -> list:
    """A row for each series: what the gates need."""
    x = returns(spark, d)
    if period:
        x = x.where("r > -1").groupBy("sym", F.trunc("d", period).alias("d")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("r"))
    return x.groupBy("sym").agg(F.count("*").alias("n"), (F.avg("r") / F.stddev_samp("r")).alias("s"), F.skewness("r").alias("g"), (F.kurtosis("r") + 3).alias("k")).orderBy("sym").collect()


@query("deflated_sharpe")
def deflated_sharpe(spark, d):
    """Against twenty trials whose Sharpe ratios spread as those of the series do, and whether the gate opens at 0.95."""
    rows = sharpe_moments(spark, d)
    variance = float(np.var([r["s"] for r in rows], ddof=1)) if len(rows) > 1 else 0.0
    found = [(r["sym"], deflated(r["s"], r["n"], variance, r["g"], r["k"], 20)) for r in rows]
    return spark.createDataFrame([(s, round(p, 6), p >= 0.95) for s, p in found], "sym string, p double, passes boolean")


@query("deflated_sharpe_monthly")
def deflated_monthly(spark, d):
    """Monthly returns against grids of trials."""
    rows = sharpe_moments(spark, d, "month")
    variance = float(np.var([r["s"] for r in rows], ddof=1)) if len(rows) > 1 else 0.0
    found = [(r["sym"], m, round(deflated(r["s"], r["n"], variance, r["g"], r["k"], m), 6)) for r in rows for m in (5, 20, 100)]
    return spark.createDataFrame(found, "sym string, trials int, p double")


#: Common days that tests by bootstrap need; with fewer they give no rows.
FEWEST = 20


def superior(diffs: np.ndarray, n_boot: int, block: float, rng: np.random.Generator) -> tuple[float, float, float]:
    """p-values (lower, consistent, upper) of the test that no strategy beats the benchmark. diffs: days by strategies."""
    from tidemark.plans.more import stationary_indices

    n = len(diffs)
    mean, sd = diffs.mean(0), diffs.std(0, ddof=1)
    stat = max(0.0, float((math.sqrt(n) * mean / sd).max()))
    bar = -sd / math.sqrt(n) * math.sqrt(2 * math.log(max(1.0, math.log(n))))
    centres = (np.maximum(mean, 0), np.where(mean >= bar, mean, 0), mean)
    hits = np.zeros(3)
    for _ in range(n_boot):
        m = diffs[stationary_indices(n, int(block), rng)].mean(0)
        hits += [max(0.0, float((math.sqrt(n) * (m - c) / sd).max())) >= stat for c in centres]
    return tuple(float(x) for x in hits / n_boot)


def day_matrix(spark, d) -> tuple[list[str], np.ndarray]:
    """Returns of the days that all symbols have: days by symbols, for tests that draw days."""
    from tidemark.sources.tables import SYMBOLS

    a = returns(spark, d).groupBy("d").pivot("sym", SYMBOLS).agg(F.max("r")).dropna().orderBy("d")
    return SYMBOLS, np.array([[r[s] for s in SYMBOLS] for r in a.collect()], float).reshape(-1, len(SYMBOLS))  # one row a day


@query("superior_ability")
def superior_ability(spark, d):
    """Whether any series beats the first, by a stationary bootstrap of common days; and the gate at 0.05. Replicates are dealt out with their seeds."""
    names, x = day_matrix(spark, d)
    if len(x) < FEWEST:
        return spark.createDataFrame([], "lower double, consistent double, upper double, passes boolean")
    diffs = x[:, 1:] - x[:, :1]
    ship(spark)

    def run(batches):
        for batch in batches:
            found = [superior(diffs, 50, 10, np.random.default_rng([42, i])) for i in batch.column("id").to_pylist()]
            yield pa.record_batch([pa.array(v) for v in zip(*found, strict=True)], ["lower", "consistent", "upper"])

    p = spark.range(10).mapInArrow(run, "lower double, consistent double, upper double")
    return p.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("lower", "consistent", "upper")), (F.avg("consistent") < 0.05).alias("passes"))


@query("sharpe_difference")
def sharpe_difference(spark, d):
    """Of each pair the difference of the Sharpe ratios, and how often centred circular-block replicates are as far from zero."""
    from tidemark.plans.decisions import circular_blocks

    names, x = day_matrix(spark, d)
    if len(x) < FEWEST:
        return spark.createDataFrame([], "x string, y string, diff double, p double")
    ship(spark)
    sharpe = lambda y: y.mean(0) / y.std(0, ddof=1)
    base = sharpe(x)

    def run(batches):
        for batch in batches:
            rows = []
            for i in batch.column("id").to_pylist():
                s = sharpe(x[circular_blocks(len(x), 10, np.random.default_rng([3, i]))])
                rows += [(names[a], names[b], float(base[a] - base[b]), bool(abs((s[a] - s[b]) - (base[a] - base[b])) >= abs(base[a] - base[b]))) for a in range(len(names)) for b in range(a + 1, len(names))]
            yield pa.record_batch([pa.array(v) for v in zip(*rows, strict=True)], ["x", "y", "diff", "far"])

    reps = spark.range(200).mapInArrow(run, "x string, y string, diff double, far boolean")
    return reps.groupBy("x", "y").agg(F.round(F.first("diff"), 6).alias("diff"), F.round(F.avg(C("far").cast("double")), 4).alias("p"))


def detectable_difference(years: float, sharpe: float, correlation: float, power: float = 0.8, alpha: float = 0.05) -> float:
    """The least difference of two Sharpe ratios that so many years show with that power."""
    spread = math.sqrt((2 - 2 * correlation + 0.5 * (2 * sharpe**2 - 2 * sharpe**2 * correlation**2)) / years)
    return (normal_quantile(1 - alpha / 2) + normal_quantile(power)) * spread


@query("mse_variance", f"WITH {BARS_SQL}, e AS (SELECT sym, lr * lr AS v, avg(lr * lr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS f, i FROM rets) SELECT sym, round(avg((v - f) ** 2), 5) AS mse FROM e WHERE i > 21 GROUP BY sym")
def mse_variance(spark, d):
    e = rets(spark, d).select("sym", "i", (C("lr") ** 2).alias("v"), F.avg(C("lr") ** 2).over(W.series().rowsBetween(-20, -1)).alias("f")).where("i > 21")
    return e.groupBy("sym").agg(F.round(F.avg((C("v") - C("f")) ** 2), 5).alias("mse"))


@query("champion_challenger", f"WITH {PAIRS}, m AS (SELECT x, y, count(*) AS n, avg(u - v) AS m, stddev_samp(u - v) AS s, avg(u) / stddev_samp(u) * sqrt(252.0) AS a, avg(v) / stddev_samp(v) * sqrt(252.0) AS b FROM p GROUP BY x, y) SELECT x, y, round(-m / s * sqrt(n), 5) AS dm, -m / s * sqrt(n) > 1.645 AND b > a + 0.2 AS promote FROM m")
def champion_challenger(spark, d):
    """The second series is promoted over the first if its gain is clear and its Sharpe ratio higher by the hurdle."""
    z = C("u") - C("v")
    annual = lambda x: F.avg(x) / F.stddev_samp(x) * math.sqrt(252)
    m = pairs(spark, d).groupBy("x", "y").agg(F.count("*").alias("n"), F.avg(z).alias("m"), F.stddev_samp(z).alias("s"), annual("u").alias("a"), annual("v").alias("b"))
    dm = -C("m") / C("s") * F.sqrt("n")
    return m.select("x", "y", F.round(dm, 5).alias("dm"), ((dm > 1.645) & (C("b") > C("a") + 0.2)).alias("promote"))


@query("series_diagnosis", f"WITH {RETS}, m AS (SELECT sym, avg(r) AS m, count(*) AS n, avg(r * r) AS q FROM x GROUP BY sym), z AS (SELECT x.sym, x.k, x.r - m.m AS e, x.r * x.r - m.q AS a, n FROM x JOIN m USING (sym)), l AS (SELECT *, " + ", ".join(f"lag(e, {k}) OVER o AS e{k}, lag(a, {k}) OVER o AS a{k}" for k in range(1, 6)) + " FROM z WINDOW o AS (PARTITION BY sym ORDER BY k)), s AS (SELECT sym, any_value(n) AS n, " + ", ".join(f"sum(e * e{k}) / sum(e * e) AS p{k}, sum(a * a{k}) / sum(a * a) AS q{k}" for k in range(1, 6)) + " FROM l GROUP BY sym) SELECT sym, round(n * (n + 2.0) * (" + " + ".join(f"p{k} * p{k} / (n - {k})" for k in range(1, 6)) + "), 4) AS ljung_box, round(n * (n + 2.0) * (" + " + ".join(f"q{k} * q{k} / (n - {k})" for k in range(1, 6)) + "), 4) AS arch FROM s")
def series_diagnosis(spark, d):
    """Portmanteau statistics of returns and of their squares over five lags."""
    x = returns(spark, d)
    m = x.groupBy("sym").agg(F.avg("r").alias("m"), F.count("*").alias("n"), F.avg(C("r") ** 2).alias("q"))
    z = x.join(F.broadcast(m), "sym").select("sym", "d", "n", (C("r") - C("m")).alias("e"), (C("r") ** 2 - C("q")).alias("a"))  # a row for each symbol
    z = z.select("*", *(F.lag(c, k).over(W.series()).alias(f"{c}{k}") for c in "ea" for k in range(1, 6)))
    s = z.groupBy("sym").agg(F.first("n").alias("n"), *((F.sum(C(c) * C(f"{c}{k}")) / F.sum(C(c) ** 2)).alias(f"p{c}{k}") for c in "ea" for k in range(1, 6)))
    box = lambda c: F.round(C("n") * (C("n") + 2.0) * sum((C(f"p{c}{k}") ** 2 / (C("n") - k) for k in range(1, 6)), F.lit(0.0)), 4)
    return s.select("sym", box("e").alias("ljung_box"), box("a").alias("arch"))


@query("unit_roots", f"WITH {BARS_SQL}, e AS (SELECT sym, ln(c) AS p, lag(ln(c)) OVER (PARTITION BY sym ORDER BY d) AS q FROM bars), f AS (SELECT sym, regr_slope(p - q, q) AS b, regr_syy(p - q, q) AS syy, regr_sxx(p - q, q) AS sxx, count(q) AS n FROM e GROUP BY sym) SELECT sym, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 4) AS t, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) < -2.86 AS stationary FROM f")
def unit_roots(spark, d):
    """The Dickey-Fuller statistic with a constant and no lags; stationary below the 5 % value."""
    e = bars_1d(spark, d).select("sym", F.log("c").alias("p"), F.log(F.lag("c").over(W.series())).alias("q")).withColumn("y", C("p") - C("q"))
    f = e.groupBy("sym").agg(F.regr_slope("y", "q").alias("b"), F.regr_syy("y", "q").alias("syy"), F.regr_sxx("y", "q").alias("sxx"), F.count("q").alias("n"))
    t = C("b") / F.sqrt((C("syy") - C("b") ** 2 * C("sxx")) / (C("n") - 2) / C("sxx"))
    return f.select("sym", F.round(t, 4).alias("t"), (t < -2.86).alias("stationary"))


@query("least_fractional_order")
def least_order(spark, d):
    """The least order of a grid that makes the first 1,000 log prices of each series stationary; later rows have no part."""
    from tidemark.plans.features import ffd_weights

    b = rets(spark, d).where("i <= 1000").select("sym", "i", F.log("c").alias("p"))
    o = Window.partitionBy("sym").orderBy("i")
    grid = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    for k, order in enumerate(grid):
        ws = ffd_weights(order, 20)
        b = b.withColumn(f"x{k}", sum((v * (F.lag("p", j).over(o) if j else C("p")) for j, v in enumerate(ws) if v), F.lit(0.0)))
    b = b.select("sym", *(f"x{k}" for k in range(len(grid))), *(F.lag(f"x{k}").over(o).alias(f"l{k}") for k in range(len(grid))))
    y = lambda k: C(f"x{k}") - C(f"l{k}")
    f = b.groupBy("sym").agg(*(F.struct(F.regr_slope(y(k), C(f"l{k}")).alias("b"), F.regr_syy(y(k), C(f"l{k}")).alias("syy"), F.regr_sxx(y(k), C(f"l{k}")).alias("sxx"), F.count(y(k)).alias("n")).alias(f"s{k}") for k in range(len(grid))))
    t = [C(f"s{k}.b") / F.sqrt((C(f"s{k}.syy") - C(f"s{k}.b") ** 2 * C(f"s{k}.sxx")) / (C(f"s{k}.n") - 2) / C(f"s{k}.sxx")) for k in range(len(grid))]
    first = F.coalesce(*(F.when(x < -2.86, F.lit(o_)) for x, o_ in zip(t, grid, strict=True)))
    return f.select("sym", first.alias("order"), F.round(t[0], 4).alias("t0"))


@query("state_occupancy", f"WITH {BARS_SQL}, s AS (SELECT sym, d, i, CASE WHEN r > 0.3 THEN 'up' WHEN r < -0.3 THEN 'down' ELSE 'flat' END AS state, (i - 1) * 4 // max(i) OVER (PARTITION BY sym) AS fold FROM rets WHERE r IS NOT NULL), e AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY sym, fold ORDER BY i) THEN 0 ELSE 1 END AS opens FROM s) SELECT sym, CAST(fold AS INT) AS fold, state, count(*) AS n, CAST(sum(opens) AS BIGINT) AS episodes, count(*) >= 30 AND sum(opens) >= 5 AS enough FROM e GROUP BY sym, fold, state")
def state_occupancy(spark, d):
    """Rows and episodes of each state in each fold, and whether they suffice."""
    x = rets(spark, d).withColumn("fold", F.floor((C("i") - 1) * 4 / F.max("i").over(Window.partitionBy("sym"))).cast("int")).where("r is not null")
    x = x.withColumn("state", F.when(C("r") > 0.3, "up").when(C("r") < -0.3, "down").otherwise("flat"))
    x = x.withColumn("opens", F.when(C("state") == F.lag("state").over(Window.partitionBy("sym", "fold").orderBy("i")), 0).otherwise(1))
    g = x.groupBy("sym", "fold", "state").agg(F.count("*").alias("n"), F.sum("opens").alias("episodes"))
    return g.withColumn("enough", (C("n") >= 30) & (C("episodes") >= 5))


def judge(values: dict[str, float], criteria: dict[str, tuple[str, float]]) -> dict[str, bool]:
    """Frozen criteria (">" or "<", bound) against values; a value that is missing fails."""
    return {k: values.get(k) is not None and (values[k] > bound if how == ">" else values[k] < bound) for k, (how, bound) in criteria.items()}


@query("promotion_gates", f"WITH {RETS}, l AS (SELECT sym, sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER (PARTITION BY sym ORDER BY d) AS l, r, d FROM x), m AS (SELECT sym, avg(r) / stddev_samp(r) * sqrt(252.0) AS s, count(*) AS n FROM l GROUP BY sym) SELECT sym, s > 0.5 AS sharpe, n >= 1000 AS history, s > 0.5 AND n >= 1000 AS passes FROM m")
def promotion_gates(spark, d):
    m = returns(spark, d).groupBy("sym").agg((F.avg("r") / F.stddev_samp("r") * math.sqrt(252)).alias("s"), F.count("*").alias("n"))
    return m.select("sym", (C("s") > 0.5).alias("sharpe"), (C("n") >= 1000).alias("history"), ((C("s") > 0.5) & (C("n") >= 1000)).alias("passes"))


@query("trade_candidates", f"WITH {PREDICTIONS}, b AS (SELECT least(9, floor(p * 10)) AS bin, sum(y) AS k, count(*) AS n FROM preds GROUP BY 1) SELECT CAST(bin AS INT) AS bin, n, round((k + 1.0) / (n + 2.0), 6) AS posterior, round((k + 1.0) / (n + 2.0) - 1.645 * sqrt((k + 1.0) * (n - k + 1.0) / ((n + 2.0) ** 2 * (n + 3.0))), 6) AS low, (k + 1.0) / (n + 2.0) - 1.645 * sqrt((k + 1.0) * (n - k + 1.0) / ((n + 2.0) ** 2 * (n + 3.0))) > 0.52 AS trade FROM b")
def trade_candidates(spark, d):
    """The posterior chance of each bin of scores, its lower bound, and whether that is above the break-even."""
    b = predictions(spark, d).groupBy(F.least(F.lit(9), F.floor(C("p") * 10)).cast("int").alias("bin")).agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    p = (C("k") + 1.0) / (C("n") + 2.0)
    low = p - 1.645 * F.sqrt((C("k") + 1.0) * (C("n") - C("k") + 1.0) / ((C("n") + 2.0) ** 2 * (C("n") + 3.0)))
    return b.select("bin", "n", F.round(p, 6).alias("posterior"), F.round(low, 6).alias("low"), (low > 0.52).alias("trade"))


FEATURES = f"{BARS_SQL}, ft AS (SELECT sym, d, i, r AS a, vol AS b, (buy - sell) / (buy + sell) AS e, CASE WHEN lead(r) OVER (PARTITION BY sym ORDER BY d) > 0 THEN 1 ELSE 0 END AS y FROM rets WHERE r IS NOT NULL)"


def features(spark, d) -> DataFrame:
    x = rets(spark, d).withColumn("y", F.when(F.lead("r").over(W.series()) > 0, 1).otherwise(0)).where("r is not null")
    return x.select("sym", "d", "i", C("r").alias("a"), C("vol").alias("b"), ((C("buy") - C("sell")) / (C("buy") + C("sell"))).alias("e"), "y")


@query("single_feature_importance", f"WITH {FEATURES}, l AS (SELECT feature, v, y FROM ft UNPIVOT (v FOR feature IN (a, b, e))), k AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS k FROM l), s AS (SELECT feature, sum(CASE WHEN y = 1 THEN k END) AS k, count_if(y = 1) AS p, count_if(y = 0) AS q FROM k GROUP BY feature) SELECT feature, round((k - p * (p + 1) / 2.0) / (p * q), 6) AS auc FROM s")
def single_feature_importance(spark, d):
    """The area under the curve of each feature alone, by distinct values."""
    x = features(spark, d)
    l_ = x.unpivot(["y"], ["a", "b", "e"], "feature", "v").groupBy("feature", "v").agg(F.count_if(C("y") == 1).alias("p"), F.count_if(C("y") == 0).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("feature").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = l_.withColumn("below", below).groupBy("feature").agg(F.sum(C("p") * (C("below") + C("q") / 2)).alias("k"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return s.select("feature", F.round(C("k") / (C("p") * C("q")), 6).alias("auc"))


@query("feature_clusters", f"WITH {FEATURES}, k AS (SELECT rank() OVER (ORDER BY a) AS a, rank() OVER (ORDER BY b) AS b, rank() OVER (ORDER BY e) AS e FROM ft) SELECT round(corr(a, b), 5) AS ab, round(corr(a, e), 5) AS ae, round(corr(b, e), 5) AS be, abs(corr(a, b)) > 0.5 AS same_ab FROM k")
def feature_clusters(spark, d):
    """Rank correlations of features, and whether two of them go into one cluster; rows are counted by distinct values, summed up by hundredths of a feature's range."""
    x = features(spark, d)
    for c in ("a", "b", "e"):
        v = x.groupBy(c).agg(F.count("*").alias("n"))
        v = v.crossJoin(F.broadcast(v.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))))  # one row
        v = W.running(v, c, F.floor(F.coalesce(F.try_divide(C(c) - C("lo"), C("hi") - C("lo")), F.lit(0.0)) * 100), upto=C("n"))
        x = x.join(v.select(c, (C("upto") - C("n") + 1).alias(f"k{c}")), c)
    return x.agg(F.round(F.corr("ka", "kb"), 5).alias("ab"), F.round(F.corr("ka", "ke"), 5).alias("ae"), F.round(F.corr("kb", "ke"), 5).alias("be"), (F.abs(F.corr("ka", "kb")) > 0.5).alias("same_ab"))


@query("shuffled_importance", f"WITH {FEATURES}, s AS (SELECT sym, i, y, a, lag(a, 25) OVER (PARTITION BY sym ORDER BY i) AS z FROM ft) SELECT sym, round(corr(a, y) - corr(z, y), 5) AS lost FROM s WHERE z IS NOT NULL GROUP BY sym")
def shuffled_importance(spark, d):
    """What a score loses when its feature is taken from another block: each block's from the one before, so that its local order stays."""
    s = features(spark, d).withColumn("z", F.lag("a", 25).over(Window.partitionBy("sym").orderBy("i"))).where("z is not null")
    return s.groupBy("sym").agg(F.round(F.corr("a", "y") - F.corr("z", "y"), 5).alias("lost"))


def kept_features(df: DataFrame, importance: dict[str, float]) -> DataFrame:
    """df without the features whose importance isn't positive; other columns stay."""
    return df.select(*(c for c in df.columns if not c.startswith("feat_") or importance.get(c, 0.0) > 0))


@query("quantile_scaled", f"WITH {BARS_SQL}, q AS (SELECT sym, quantile_cont(abs(r), 0.9) AS q FROM rets WHERE i <= 1000 GROUP BY sym) SELECT sym, d, round(greatest(-1, least(1, r / q)), 6) AS v FROM rets JOIN q USING (sym) WHERE r IS NOT NULL")
def quantile_scaled(spark, d):
    """Scaled symmetrically around zero by a quantile of the training rows."""
    q = rets(spark, d).where("i <= 1000").groupBy("sym").agg(F.percentile(F.abs("r"), 0.9).alias("q"))
    x = rets(spark, d).where("r is not null").join(F.broadcast(q), "sym")  # a row for each symbol
    return out(x, "sym", "d", v=F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(C("r"), C("q")))))


def quantile_step(q: float):
    """A running quantile from five markers whose heights follow parabolas: (time, value)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, x = row
        if x is None:
            return [(at, None)]
        h, n = s["h"], s["n"]
        if len(h) < 5:
            h.append(x)
            h.sort()
            return [(at, h[int(q * (len(h) - 1))])]
        if x < h[0]:
            h[0], k = x, 0
        elif x >= h[4]:
            h[4], k = x, 3
        else:
            k = max(i for i in range(4) if h[i] <= x)
        for i in range(k + 1, 5):
            n[i] += 1
        for i, gain in enumerate((0, q / 2, q, (1 + q) / 2, 1)):
            s["want"][i] += gain
        for i in (1, 2, 3):
            off = s["want"][i] - n[i]
            if (off >= 1 and n[i + 1] - n[i] > 1) or (off <= -1 and n[i - 1] - n[i] < -1):
                z = 1 if off > 0 else -1
                new = h[i] + z / (n[i + 1] - n[i - 1]) * ((n[i] - n[i - 1] + z) * (h[i + 1] - h[i]) / (n[i + 1] - n[i]) + (n[i + 1] - n[i] - z) * (h[i] - h[i - 1]) / (n[i] - n[i - 1]))
                h[i] = new if h[i - 1] < new < h[i + 1] else h[i] + z * (h[i + z] - h[i]) / (n[i + z] - n[i])
                n[i] += z
        return [(at, h[2])]

    return lambda: {"h": [], "n": [1, 2, 3, 4, 5], "want": [1, 1 + 2 * q, 1 + 4 * q, 3 + 2 * q, 5]}, step


@query("online_quantile")
def online_quantile(spark, d):
    x = rets(spark, d).where("r is not null").select("sym", C("i").cast("long").alias("i"), "r")
    k = S.fold(x, "sym", ["i"], ["i", "r"], *quantile_step(0.5), "sym string, at long, v double", ["sym", "at", "v"], [pa.string(), pa.int64(), pa.float64()])
    return out(k, "sym", "at", v=C("v"))


@query("rank_scaled", f"WITH {BARS_SQL}, y AS (SELECT sym, d, lr, list(lr) OVER f AS a FROM rets {w(60)}) SELECT sym, d, round(least(0.99, greatest(0.01, len(list_filter(a, lambda v: v < lr)) / (len(list_filter(a, lambda v: v IS NOT NULL)) - 1))), 6) AS v FROM y WHERE lr IS NOT NULL AND len(list_filter(a, lambda v: v IS NOT NULL)) >= 30")
def rank_scaled(spark, d):
    """The rank among the last 60 values, from 30 on, clipped."""
    y = rets(spark, d).withColumn("a", F.collect_list("lr").over(W.trailing(60))).where(C("lr").isNotNull() & (F.size("a") >= 30))
    return out(y, "sym", "d", v=F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.size(F.filter("a", lambda v: v < C("lr"))) / (F.size("a") - 1))))


# Books in order


def engine_step(limit: float, cost: float):
    """One series through a book: mark, fill what was decided a bar before, pay funding, mark again, decide under a limit: (time, quantity, cash, equity, verified)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, price, funding_rate, want = row
        if price is None:
            return []
        value = s["cash"] + s["q"] * price
        target = s["want"] * value / price if value > 0 else 0.0  # decided a bar before, filled at this one
        dq = target - s["q"]
        paid = abs(dq) * price * cost
        s["cash"] -= dq * price + paid
        s["q"] = target
        s["cash"] -= s["q"] * price * (funding_rate or 0.0)
        s["paid"] += paid
        equity = s["cash"] + s["q"] * price
        s["want"] = max(-limit, min(limit, want or 0.0)) if equity > 0.5 * s["peak"] else 0.0
        s["peak"] = max(s["peak"], equity)
        ok = abs(equity - (value - paid - s["q"] * price * (funding_rate or 0.0))) < 1e-6 * max(1.0, abs(value))
        return [(at, s["q"], s["cash"], equity, ok)]

    return lambda: {"cash": 1e6, "q": 0.0, "want": 0.0, "peak": 1e6, "paid": 0.0}, step


def engine(spark, d) -> DataFrame:
    u = funding(spark, d).groupBy("sym", "d").agg(F.sum("rate").alias("rate"))
    x = rets(spark, d).join(u, ["sym", "d"], "left").withColumn("want", F.tanh(5 * F.coalesce("r", F.lit(0.0))))
    x = x.select("sym", C("i").cast("long").alias("i"), "c", "rate", "want")
    return S.fold(x, "sym", ["i"], ["i", "c", "rate", "want"], *engine_step(0.5, 0.0005), "sym string, at long, q double, cash double, equity double, ok boolean", ["sym", "at", "q", "cash", "equity", "ok"], [pa.string(), pa.int64(), *[pa.float64()] * 3, pa.bool_()])


@query("event_driven_book")
def event_driven_book(spark, d):
    """Each series as an account of its own, bar by bar."""
    return engine(spark, d).select("sym", "at", F.round("q", 6).alias("q"), F.round("equity", 2).alias("equity"))


@query("ledger_verified")
def ledger_verified(spark, d):
    """Whether every bar's equity is what the bar before, prices, costs and funding make of it."""
    return engine(spark, d).groupBy("sym").agg(F.count("*").alias("n"), F.min("ok").alias("balanced"))


@query("accounts_combined")
def accounts_combined(spark, d):
    """The accounts' equity added up bar by bar."""
    return engine(spark, d).groupBy("at").agg(F.count("*").alias("accounts"), F.round(F.sum("equity"), 2).alias("equity"))


def basis_step(band: float, floor: float):
    """Spot long against perpetual short: enter, rebalance a leg that has drifted, or leave where the margin runs low: (time, action, quantity, margin)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, spot, perp, basis = row
        if spot is None or perp is None:
            return [(at, "unhedged" if s["q"] else "wait", s["q"], None)]
        margin = 1 - (perp - s["entry"]) * s["q"] / max(1e-9, spot * s["q"]) if s["q"] else 1.0
        if s["q"] and margin < floor:
            s.update(q=0.0, entry=0.0)
            return [(at, "margin", 0.0, margin)]
        if not s["q"] and basis is not None and basis > band:
            s.update(q=1e6 / spot, entry=perp)
            return [(at, "enter", s["q"], 1.0)]
        if s["q"] and abs(s["q"] * spot / 1e6 - 1) > 1.0:
            s.update(q=1e6 / spot, entry=perp)
            return [(at, "drift", s["q"], margin)]
        return [(at, "hold" if s["q"] else "wait", s["q"], margin)]

    return lambda: {"q": 0.0, "entry": 0.0}, step


@query("basis_book")
def basis_book(spark, d):
    from tidemark.plans.temporal import legs

    perp, spot = legs(spark, d)
    x = perp.join(spot, ["sym", "d"], "left").select("sym", "d", "s", "c", (F.try_divide("c", "s") - 1).alias("b")).withColumn("i", F.row_number().over(W.series()).cast("long"))
    return S.fold(x.withColumnRenamed("s", "spot"), "sym", ["i"], ["i", "spot", "c", "b"], *basis_step(0.05, 0.2), "sym string, at long, action string, q double, margin double", ["sym", "at", "action", "q", "margin"], [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64()]).select("sym", "at", "action", F.round("q", 6).alias("q"))


def greedy_step():
    """Trades that don't overlap: the next one is taken once the last one is over: (entry, exit, side, return)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, end, side, ret = row
        if at < s["free"] or side == 0:
            return []
        s["free"] = end
        return [(at, end, side, ret)]

    return lambda: {"free": -1}, step


@query("non_overlapping_trades")
def non_overlapping(spark, d):
    """The greedy choice among signals on either side, by their score over its threshold."""
    x = rets(spark, d).where("r is not null").withColumn("ahead", F.try_divide(F.lead("c", 5).over(W.series()), C("c")) - 1).where("ahead is not null")
    long, short = F.abs(F.tanh(C("r"))) / 0.4, F.abs(F.tanh(-C("r"))) / 0.5
    side = F.when((C("r") < 0) & (long >= 1), 1).when((C("r") > 0) & (short >= 1), -1).otherwise(0)
    x = x.select("sym", C("i").cast("long").alias("i"), (C("i") + 5).cast("long").alias("end"), side.alias("side"), "ahead")
    k = S.fold(x, "sym", ["i"], ["i", "end", "side", "ahead"], *greedy_step(), "sym string, entry long, exit long, side int, ret double", ["sym", "entry", "exit", "side", "ret"], [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64()])
    return k.groupBy("sym").agg(F.count("*").alias("n"), F.round(F.avg(C("side") * C("ret") - 0.001), 6).alias("mean"))


@query("collisions_resolved", f"WITH {BARS_SQL}, x AS (SELECT sym, d, abs(tanh(r)) / 0.55 AS a, abs(tanh(lag(r) OVER (PARTITION BY sym ORDER BY d))) / 0.5 AS b FROM rets) SELECT sym, d, round((a - b) / (a + b), 6) AS w, CASE WHEN a >= b THEN 10 ELSE 5 END AS horizon FROM x WHERE a >= 1 AND b >= 1")
def collisions_resolved(spark, d):
    """Where both sides fire: net weight by their scores over the thresholds, and the winner's horizon."""
    x = rets(spark, d).select("sym", "d", (F.abs(F.tanh("r")) / 0.55).alias("a"), (F.abs(F.tanh(F.lag("r").over(W.series()))) / 0.5).alias("b")).where("a >= 1 and b >= 1")
    return x.select("sym", "d", F.round((C("a") - C("b")) / (C("a") + C("b")), 6).alias("w"), F.when(C("a") >= C("b"), 10).otherwise(5).alias("horizon"))


LAYERS = f"{WEIGHTS}, h AS (SELECT sym, d, r, w, lag(w) OVER o AS l1, lag(w, 2) OVER o AS l2 FROM w WINDOW o AS (PARTITION BY sym ORDER BY d))"


@query("layers", f"WITH {LAYERS}, p AS (SELECT d, sum(coalesce(l1, 0) * coalesce(r, 0)) AS vectorised, sum(least(coalesce(l1, 0), 0.25) * coalesce(r, 0)) AS risk, sum(least(coalesce(l2, 0), 0.25) * coalesce(r, 0)) AS latency, sum(least(coalesce(l2, 0), 0.25) * coalesce(r, 0)) - 0.0005 * sum(abs(coalesce(l1, 0) - coalesce(l2, 0))) AS costs FROM h GROUP BY d) SELECT round(avg(vectorised) * 252, 5) AS vectorised, round(avg(risk) * 252, 5) AS risk, round(avg(latency) * 252, 5) AS latency, round(avg(costs) * 252, 5) AS costs FROM p")
def layers(spark, d):
    """One book with a layer more each time: limits, a bar of latency, costs."""
    o = W.series()
    z = lambda c: F.coalesce(C(c), F.lit(0.0))
    h = inverse_vol(spark, d).withColumn("l1", F.lag("w").over(o)).withColumn("l2", F.lag("w", 2).over(o))
    cap = lambda c: F.least(z(c), F.lit(0.25))
    p = h.groupBy("d").agg(F.sum(z("l1") * z("r")).alias("a"), F.sum(cap("l1") * z("r")).alias("b"), F.sum(cap("l2") * z("r")).alias("c"), F.sum(F.abs(z("l1") - z("l2"))).alias("t"))
    return p.agg(*(F.round(F.avg(x) * 252, 5).alias(n) for n, x in (("vectorised", "a"), ("risk", "b"), ("latency", "c"), ("costs", C("c") - 0.0005 * C("t")))))


@query("overlay_arms", f"WITH {LAYERS}, u AS (SELECT sym, d, CASE WHEN c > avg(c) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) THEN 1.0 ELSE 0.5 END AS up FROM bars), m AS (SELECT sym, d, lag(up) OVER (PARTITION BY sym ORDER BY d) AS m FROM u), p AS (SELECT h.d, sum(coalesce(l1, 0) * coalesce(r, 0)) AS a, sum(coalesce(l1, 0) * coalesce(m, 1) * coalesce(r, 0)) AS b FROM h JOIN m USING (sym, d) GROUP BY h.d) SELECT round(avg(a) * 252, 5) AS plain, round(avg(b) * 252, 5) AS overlaid, round((avg(b) - avg(a)) * 252, 5) AS gain FROM p")
def overlay_arms(spark, d):
    """A book with and without an overlay on its exposures."""
    o = W.series()
    h = inverse_vol(spark, d).withColumn("l1", F.coalesce(F.lag("w").over(o), F.lit(0.0)))
    h = h.withColumn("up", F.when(C("c") > F.avg("c").over(W.trailing(100)), 1.0).otherwise(0.5)).withColumn("m", F.coalesce(F.lag("up").over(o), F.lit(1.0)))
    p = h.groupBy("d").agg(F.sum(C("l1") * F.coalesce("r", F.lit(0.0))).alias("a"), F.sum(C("l1") * C("m") * F.coalesce("r", F.lit(0.0))).alias("b"))
    return p.agg(F.round(F.avg("a") * 252, 5).alias("plain"), F.round(F.avg("b") * 252, 5).alias("overlaid"), F.round((F.avg("b") - F.avg("a")) * 252, 5).alias("gain"))


@query("drawdown_shapes")
def drawdown_shapes(spark, d):
    """Deepest drawdown over volatility of 300 random walks with a Sharpe ratio of one, over four years: quantiles."""
    ship(spark)

    def run(batches):
        for batch in batches:
            found = []
            for i in batch.column("id").to_pylist():
                x = np.cumsum(np.random.default_rng([9, i]).normal(1 / 252, 1 / math.sqrt(252), 1008))
                found.append(float((np.maximum.accumulate(np.append(0.0, x))[1:] - x).max()))
            yield pa.record_batch([pa.array(found)], ["dd"])

    return spark.range(300).mapInArrow(run, "dd double").agg(*(F.round(F.percentile("dd", q), 5).alias(n) for n, q in (("low", 0.05), ("median", 0.5), ("high", 0.95))))


# Live rules


@query("funding_first_of_window", f"WITH {TICKS_SQL}, x AS (SELECT sym, ts, seq, row_number() OVER (PARTITION BY sym, time_bucket(INTERVAL 8 HOUR, ts) ORDER BY ts, seq) AS k FROM ticks) SELECT sym, seq, CASE WHEN k = 1 THEN 0.0001::DOUBLE END AS rate FROM x")
def funding_first(spark, d):
    """The rate on the first tick of each window of eight hours alone."""
    t = ticks(spark, d).withColumn("w", F.window("ts", "8 hours")["start"])
    k = F.row_number().over(Window.partitionBy("sym", "w").orderBy("ts", "seq"))
    return t.withColumn("k", k).select("sym", "seq", F.when(C("k") == 1, 0.0001).alias("rate"))


@query("sequence_gaps", "WITH x AS (SELECT event_type AS sym, event_id, ts, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events) SELECT sym, count_if(gap > INTERVAL 2 HOUR) AS halts, CAST(floor(epoch(max(gap))) AS BIGINT) AS longest FROM x GROUP BY sym")
def sequence_gaps(spark, d):
    """Holes of over two hours between ticks, which halt a live run, and the longest in whole seconds."""
    t = ticks(spark, d)
    gap = F.unix_micros(C("ts").cast("timestamp")) - F.lag(F.unix_micros(C("ts").cast("timestamp"))).over(Window.partitionBy("sym").orderBy("ts", "seq"))
    x = t.select("sym", gap.alias("gap"))
    return x.groupBy("sym").agg(F.count_if(C("gap") > 7_200_000_000).alias("halts"), F.floor((F.max("gap") + 0) / 1_000_000).alias("longest"))


def breaker_rules_step(drawdown: float, daily: float, hold: int):
    """Latched halts: a drawdown, a day's loss, a position held too long: (time, reason)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, day, equity = row
        if day != s["day"]:
            s.update(day=day, open=equity)
        s["peak"] = max(s["peak"], equity)
        s["n"] += 1
        if not s["halt"]:
            s["halt"] = "drawdown" if 1 - equity / s["peak"] >= drawdown else "daily" if 1 - equity / s["open"] >= daily else "held" if s["n"] > hold else ""
        return [(at, s["halt"])]

    return lambda: {"day": None, "open": 1.0, "peak": 0.0, "n": 0, "halt": ""}, step


@query("circuit_breaker", "WITH t AS (SELECT event_type AS sym, ts, event_id, CAST(ts AS DATE) AS day, 1000 + value AS e FROM events), o AS (SELECT *, 1 - e / first_value(e) OVER (PARTITION BY sym, day ORDER BY ts, event_id) AS loss, 1 - e / max(e) OVER (PARTITION BY sym ORDER BY ts, event_id) AS dd, row_number() OVER (PARTITION BY sym ORDER BY ts, event_id) AS n FROM t), r AS (SELECT *, CASE WHEN dd >= 0.15 THEN 'drawdown' WHEN loss >= 0.1 THEN 'daily' WHEN n > 500 THEN 'held' END AS why FROM o) SELECT sym, event_id AS at, coalesce(first_value(why IGNORE NULLS) OVER (PARTITION BY sym ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS reason FROM r")
def circuit_breaker(spark, d):
    t = ticks(spark, d).select("sym", "ts", "seq", F.to_date("ts").cast("string").alias("day"), (1000 + C("price")).alias("e"))
    return S.fold(t, "sym", ["ts", "seq"], ["seq", "day", "e"], *breaker_rules_step(0.15, 0.1, 500), "sym string, at long, reason string", ["sym", "at", "reason"], [pa.string(), pa.int64(), pa.string()])


@query("stale_quotes", f"WITH {TICKS_SQL}, x AS (SELECT sym, seq, price, ts - lag(ts) OVER (PARTITION BY sym ORDER BY ts, seq) AS age, lag(price) OVER (PARTITION BY sym ORDER BY ts, seq) AS q FROM ticks) SELECT sym, seq, CASE WHEN age <= INTERVAL 30 MINUTE THEN round(q, 6) END AS quote FROM x")
def stale_quotes(spark, d):
    """The last quote before each tick, unless it is older than half an hour."""
    o = Window.partitionBy("sym").orderBy("ts", "seq")
    t = ticks(spark, d).withColumn("q", F.lag("price").over(o)).withColumn("t", F.lag("ts").over(o))
    return t.select("sym", "seq", F.when(C("ts") - C("t") <= F.expr("interval 30 minutes"), F.round("q", 6)).alias("quote"))


@query("ring_buffer", f"WITH {TICKS_SQL}, x AS (SELECT sym, seq, row_number() OVER (PARTITION BY sym ORDER BY ts, seq) AS n, avg(price) OVER (PARTITION BY sym ORDER BY ts, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS v FROM ticks) SELECT sym, seq, round(last_value(CASE WHEN n % 10 = 0 THEN v END IGNORE NULLS) OVER (PARTITION BY sym ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS v FROM x")
def ring_buffer(spark, d):
    """A feature over the last fifty ticks, refreshed every tenth, the cached value between."""
    o = Window.partitionBy("sym").orderBy("ts", "seq")
    t = ticks(spark, d).withColumn("n", F.row_number().over(o)).withColumn("m", F.avg("price").over(o.rowsBetween(-49, 0)))
    return out(t, "sym", "seq", v=F.last(F.when(C("n") % 10 == 0, C("m")), ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0)))


@query("signal_conflicts", f"WITH {BARS_SQL}, x AS (SELECT sym, d, tanh(5 * r) AS a, -tanh(5 * lag(r) OVER (PARTITION BY sym ORDER BY d)) AS b FROM rets) SELECT sym, d, round(CASE WHEN a * b < 0 THEN CASE WHEN abs(abs(a) - abs(b)) < 0.1 THEN 0 WHEN abs(a) > abs(b) THEN a ELSE b END ELSE 0.6 * a + 0.4 * b END, 6) + 0.0 AS v FROM x WHERE a IS NOT NULL AND b IS NOT NULL")
def signal_conflicts(spark, d):
    """Opposite signals: the surer one, or none where they are about as sure; others are weighed together."""
    x = rets(spark, d).select("sym", "d", F.tanh(5 * C("r")).alias("a"), (-F.tanh(5 * F.lag("r").over(W.series()))).alias("b")).where("a is not null and b is not null")
    p, q = F.abs("a"), F.abs("b")
    return out(x, "sym", "d", v=F.when(C("a") * C("b") < 0, F.when(F.abs(p - q) < 0.1, 0.0).when(p > q, C("a")).otherwise(C("b"))).otherwise(0.6 * C("a") + 0.4 * C("b")))


def paper_step(slip: float, fee: float):
    """Paper fills at the reference price with slippage and fee inside it: (time, quantity, price, cash)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, price, qty = row
        paid = price * (1 + (slip + fee) * (1 if qty > 0 else -1))
        s["q"] += qty
        s["cash"] -= qty * paid
        return [(at, s["q"], paid, s["cash"])]

    return lambda: {"q": 0.0, "cash": 0.0}, step


@query("paper_fills", f"WITH {TICKS_SQL}, x AS (SELECT *, CASE WHEN side = 'buy' THEN qty ELSE -qty END AS q FROM ticks) SELECT sym, seq AS at, sum(q) OVER w AS position, round(price * (1 + 0.0007 * sign(q)), 6) AS paid, round(-sum(q * price * (1 + 0.0007 * sign(q))) OVER w, 7) AS cash FROM x WINDOW w AS (PARTITION BY sym ORDER BY ts, seq)")
def paper_fills(spark, d):
    t = ticks(spark, d).select("sym", "ts", "seq", "price", F.when(C("side") == "buy", C("qty")).otherwise(-C("qty")).alias("q"))
    k = S.fold(t, "sym", ["ts", "seq"], ["seq", "price", "q"], *paper_step(0.0002, 0.0005), "sym string, at long, position double, paid double, cash double", ["sym", "at", "position", "paid", "cash"], [pa.string(), pa.int64(), *[pa.float64()] * 3])
    return k.select("sym", "at", "position", F.round("paid", 6).alias("paid"), F.round("cash", 7).alias("cash"))


@query("accrued_funding", f"WITH {FUNDING_SQL}, {BARS_SQL}, p AS (SELECT sym, d, sum(buy - sell) OVER (PARTITION BY sym ORDER BY d) AS q, c FROM bars), u AS (SELECT sym, d, sum(rate) AS x FROM funding GROUP BY ALL) SELECT p.sym, p.d, round(-q * c * x, 4) AS flow FROM p JOIN u USING (sym, d)")
def accrued_funding(spark, d):
    """What a position pays or gets when funding settles."""
    u = funding(spark, d).groupBy("sym", "d").agg(F.sum("rate").alias("x"))
    p = bars_1d(spark, d).withColumn("q", F.sum(C("buy") - C("sell")).over(W.expanding()))
    return p.join(u, ["sym", "d"]).select("sym", "d", F.round(-C("q") * C("c") * C("x"), 4).alias("flow"))


@query("live_sharpe_monitor", f"WITH {RETS} SELECT sym, d, round(avg(r) OVER f / stddev_samp(r) OVER f * sqrt(252.0), 5) AS live, k >= 20 AND (1.0 - avg(r) OVER f / stddev_samp(r) OVER f * sqrt(252.0)) / 0.5 >= 2 AS halt FROM x WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)")
def live_sharpe(spark, d):
    """The last 252 returns against the backtest's ratio; a halt two deviations below it, from twenty returns on."""
    f = W.trailing(252)
    x = returns(spark, d).withColumn("s", F.try_divide(F.avg("r").over(f), F.stddev_samp("r").over(f)) * math.sqrt(252))
    return x.select("sym", "d", F.round("s", 5).alias("live"), ((C("k") >= 20) & ((1.0 - C("s")) / 0.5 >= 2)).alias("halt"))


@query("vol_forecast_monitor", f"WITH {BARS_SQL}, e AS (SELECT sym, d, i, lr * lr + 1e-8 AS v, avg(lr * lr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) + 1e-8 AS f FROM rets), q AS (SELECT sym, d, i, v / f - ln(v / f) - 1 AS q FROM e WHERE i > 21) SELECT sym, d, round(avg(q) OVER w, 4) AS qlike, avg(q) OVER w > 3.5 AS alarm FROM q WINDOW w AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)")
def vol_forecast(spark, d):
    e = rets(spark, d).select("sym", "d", "i", (C("lr") ** 2 + 1e-8).alias("v"), (F.avg(C("lr") ** 2).over(W.series().rowsBetween(-20, -1)) + 1e-8).alias("f")).where("i > 21")
    m = F.avg(C("v") / C("f") - F.log(C("v") / C("f")) - 1).over(W.trailing(1000))
    return e.select("sym", "d", F.round(m, 4).alias("qlike"), (m > 3.5).alias("alarm"))


@query("execution_drift", f"WITH {TICKS_SQL}, t AS (SELECT sym, side, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (price / lag(nullif(price, 0)) OVER (PARTITION BY sym ORDER BY ts, seq) - 1) * 1e4 AS bps, epoch(ts - lag(ts) OVER (PARTITION BY sym ORDER BY ts, seq)) AS wait FROM ticks) SELECT sym, count_if(bps > 20) AS adverse, count_if(wait > 1800) AS late FROM t GROUP BY sym")
def execution_drift(spark, d):
    """Trades that cost over twenty basis points, and those that came late."""
    o = Window.partitionBy("sym").orderBy("ts", "seq")
    before = F.lag(F.nullif(C("price"), F.lit(0.0))).over(o)
    t = ticks(spark, d).withColumn("bps", F.when(C("side") == "buy", 1).otherwise(-1) * (C("price") / before - 1) * 1e4)
    t = t.withColumn("wait", (F.unix_micros(C("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(o).cast("timestamp"))) / 1e6)
    return t.groupBy("sym").agg(F.count_if(C("bps") > 20).alias("adverse"), F.count_if(C("wait") > 1800).alias("late"))


@query("account_throttle", f"WITH {PAIRS}, m AS (SELECT x, y, corr(u, v) AS k, avg(u) / stddev_samp(u) AS a, avg(v) / stddev_samp(v) AS b FROM p GROUP BY x, y) SELECT x, y, round(k, 5) AS corr, CASE WHEN k > 0.01 THEN CASE WHEN a < b THEN x ELSE y END END AS throttled FROM m")
def account_throttle(spark, d):
    """Of accounts that move together the one with the lower Sharpe ratio is throttled."""
    ratio = lambda x: F.avg(x) / F.stddev_samp(x)
    m = pairs(spark, d).groupBy("x", "y").agg(F.corr("u", "v").alias("k"), ratio("u").alias("a"), ratio("v").alias("b"))
    return m.select("x", "y", F.round("k", 5).alias("corr"), F.when(C("k") > 0.01, F.when(C("a") < C("b"), C("x")).otherwise(C("y"))).alias("throttled"))


@query("entropy_gate", f"WITH {PREDICTIONS}, e AS (SELECT doc_id, p, -(p * ln(greatest(p, 1e-12)) + (1 - p) * ln(greatest(1 - p, 1e-12))) / ln(2.0) AS h FROM (SELECT l.doc_id, (d.n_chars % 1000) / 1000.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id))), q AS (SELECT quantile_cont(h, 0.7) AS q FROM e) SELECT doc_id, round(h, 6) AS entropy, h <= least(q, 0.95) AS passes FROM e, q")
def entropy_gate(spark, d):
    """Predictions whose entropy is low enough: below a quantile of all and an absolute bound."""
    p = C("p")
    h = -(p * F.log(F.greatest(p, F.lit(1e-12))) + (1 - p) * F.log(F.greatest(1 - p, F.lit(1e-12)))) / math.log(2)
    e = predictions(spark, d).withColumn("h", h)
    q = e.agg(F.percentile("h", 0.7).alias("q"))
    return e.crossJoin(F.broadcast(q)).select("doc_id", F.round("h", 6).alias("entropy"), (C("h") <= F.least(C("q"), F.lit(0.95))).alias("passes"))  # one row


def schema_hash(df: DataFrame) -> str:
    """A fingerprint of the columns and their types, for a guard against a changed feature schema."""
    return hashlib.sha256(json.dumps(sorted((f.name, f.dataType.simpleString()) for f in df.schema)).encode()).hexdigest()


def guarded(df: DataFrame, expected: str) -> DataFrame:
    if (found := schema_hash(df)) != expected:
        raise ValueError(f"the feature schema has changed: {found[:12]} instead of {expected[:12]}")
    return df


# What users plug in


class Features:
    """Registered features: functions of a DataFrame that add columns, with the rows they need before the first value."""

    def __init__(self):
        self.known: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str], int]] = {}

    def register(self, name: str, f: Callable[[DataFrame], DataFrame], columns: list[str], burn_in: int) -> None:
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        self.known[name] = (f, columns, burn_in)

    def digest(self, name: str, **parameters) -> str:
        """Of a feature's name, columns and parameters: what a stored result is filed under."""
        _, columns, burn_in = self.known[name]
        return hashlib.sha256(json.dumps([name, columns, burn_in, parameters], sort_keys=True, default=str).encode()).hexdigest()

    def burn_in(self, names: list[str]) -> int:
        """Of a chain: each feature sees the rows that those before it have dropped."""
        return sum(self.known[n][2] for n in names)

    def apply(self, df: DataFrame, names: list[str], by: str = "sym", order: str = "d") -> DataFrame:
        """A chain by name; values within the burn-in are null."""
        k = F.row_number().over(Window.partitionBy(by).orderBy(order))
        df, need = df.withColumn("_k", k), 0
        for n in names:
            f, columns, burn_in = self.known[n]
            need += burn_in
            df = f(df).withColumns({c: F.when(F.col("_k") > need, F.col(c)) for c in columns})
        return df.drop("_k")


FEATURES_KNOWN = Features()
FEATURES_KNOWN.register("log_return", lambda df: df.withColumn("feat_lr", F.log(F.try_divide(F.col("c"), F.lag("c").over(W.series())))), ["feat_lr"], 1)
FEATURES_KNOWN.register("volatility", lambda df: df.withColumn("feat_vol", F.stddev_samp("feat_lr").over(W.trailing(20))), ["feat_vol"], 19)


@query("feature_chain", f"WITH {BARS_SQL} SELECT sym, d, round(CASE WHEN i > 1 THEN lr END, 6) AS feat_lr, round(CASE WHEN i > 20 THEN stddev_samp(lr) OVER f END, 6) AS feat_vol FROM rets {w(20)}")
def feature_chain(spark, d):
    """Two registered features by their names, with their burn-in."""
    x = FEATURES_KNOWN.apply(bars_1d(spark, d), ["log_return", "volatility"])
    return x.select("sym", "d", F.round("feat_lr", 6).alias("feat_lr"), F.round("feat_vol", 6).alias("feat_vol"))


def grouped_metric(df: DataFrame, by: list[str], column: str, metric: Callable[[np.ndarray], float], name: str) -> DataFrame:
    """A user's own metric over the values of each group, which have to fit into one task; the built-in ones need no such call."""
    from pyspark.sql.functions import pandas_udf

    ship(df.sparkSession)
    return df.groupBy(*by).agg(pandas_udf(lambda v: float(metric(v.to_numpy())), "double", functionType=202)(F.col(column)).alias(name))


@query("own_metric", f"WITH {RETS}, y AS (SELECT sym, year(d) AS y, quantile_cont(r, 0.5) AS m FROM x GROUP BY ALL) SELECT sym, CAST(y AS INT) AS y, round(m, 6) AS v FROM y")
def own_metric(spark, d):
    """A median by a user's function over the returns of a year."""
    x = returns(spark, d).withColumn("y", F.year("d"))
    return grouped_metric(x, ["sym", "y"], "r", np.median, "m").select("sym", "y", F.round("m", 6).alias("v"))


def check_alpha(exposures: DataFrame, column: str, burn_in: int, by: str = "sym", order: str = "d") -> dict[str, int]:
    """Rows that break an alpha's contract: exposures beyond one, values within the burn-in, repeated rows."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(order))
    x = exposures.withColumn("_k", k)
    repeated = exposures.groupBy(by, order).agg(F.count("*").alias("n")).where("n > 1").count()
    row = x.agg(F.count_if(F.abs(column) > 1).alias("beyond"), F.count_if((F.col("_k") <= burn_in) & F.col(column).isNotNull()).alias("early")).first()
    return {"beyond": row["beyond"], "early": row["early"], "repeated": repeated}


def register_source(spark: SparkSession, source: type) -> None:
    """A user's data source (a class of the Python data source interface), known to spark.read.format by its name."""
    ship(spark)
    spark.dataSource.register(source)


# States and forecasts that are fitted


def markov_fit(counts: np.ndarray) -> np.ndarray:
    """A transition matrix with one count added to each cell."""
    p = counts + 1.0
    return p / p.sum(1, keepdims=True)


@query("markov_chain", f"WITH {BARS_SQL}, s AS (SELECT sym, d, CASE WHEN r > 0.3 THEN 2 WHEN r < -0.3 THEN 0 ELSE 1 END AS s FROM rets WHERE r IS NOT NULL), p AS (SELECT s AS a, lead(s) OVER (PARTITION BY sym ORDER BY d) AS b FROM s), n AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b) SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, round((n + 1.0) / (sum(n) OVER (PARTITION BY a) + 3.0), 6) AS p FROM n")
def markov_chain(spark, d):
    x = returns(spark, d).withColumn("s", F.when(C("r") > 0.3, 2).when(C("r") < -0.3, 0).otherwise(1))
    n = x.select(C("s").alias("a"), F.lead("s").over(W.series()).alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.select("a", "b", F.round((C("n") + 1.0) / (F.sum("n").over(Window.partitionBy("a")) + 3.0), 6).alias("p"))


def filter_step(stay: float, low: float, high: float):
    """The chance of the volatile one of two normal states given the past alone: (time, chance)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, x = row
        prior = stay * s["p"] + (1 - stay) * (1 - s["p"])
        if x is not None:
            like = [math.exp(-0.5 * (x / v) ** 2) / v + 1e-300 for v in (low, high)]
            prior = prior * like[1] / (prior * like[1] + (1 - prior) * like[0])
        s["p"] = prior
        return [(at, prior)]

    return lambda: {"p": 0.5}, step


@query("hidden_states")
def hidden_states(spark, d):
    """Filtered chances of a two-state model with fixed deviations; nothing is smoothed backwards."""
    x = rets(spark, d).select("sym", C("i").cast("long").alias("i"), "lr")
    k = S.fold(x, "sym", ["i"], ["i", "lr"], *filter_step(0.95, 0.5, 1.5), "sym string, at long, p double", ["sym", "at", "p"], [pa.string(), pa.int64(), pa.float64()])
    return out(k, "sym", "at", p=C("p"))


@query("har_fit", f"WITH {BARS_SQL}, e AS (SELECT sym, i, lr * lr AS v, avg(lr * lr) OVER (PARTITION BY sym ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f FROM rets) SELECT sym, round(regr_slope(v, f), 5) AS slope, round(regr_intercept(v, f), 5) AS base, round(regr_r2(v, f), 5) AS r2 FROM e WHERE i > 6 GROUP BY sym")
def har_fit(spark, d):
    """Variance on the mean of the five before: the weekly term of the cascade."""
    f = W.series(order="i").rowsBetween(-5, -1)
    e = rets(spark, d).select("sym", "i", (C("lr") ** 2).alias("v"), F.avg(C("lr") ** 2).over(f).alias("f")).where("i > 6")
    return e.groupBy("sym").agg(F.round(F.regr_slope("v", "f"), 5).alias("slope"), F.round(F.regr_intercept("v", "f"), 5).alias("base"), F.round(F.regr_r2("v", "f"), 5).alias("r2"))
