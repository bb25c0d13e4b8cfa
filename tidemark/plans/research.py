"""Events and labels, splits, portfolios, risk, books, execution, statistics."""

from __future__ import annotations

import math
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import sequential as S
from tidemark.operators import windows as W
from tidemark.plans.features import rets
from tidemark.plans.registry import out, query
from tidemark.sources.tables import BARS_SQL, FUNDING_SQL, TICKS_SQL, bars_1d, funding, table, ticks, trades

C = F.col
BAR = ["sym", "at", "o", "h", "l", "c", "vol", "n"]
BAR_SCHEMA = "sym string, at long, o double, h double, l double, c double, vol double, n long"
BAR_TYPES = [pa.string(), pa.int64(), *[pa.float64()] * 5, pa.int64()]


def info_bars(t: DataFrame, maker, columns: list[str]) -> DataFrame:
    start, step = maker
    done = S.fold(t, "sym", ["ts", "seq"], ["seq", *columns], start, step, BAR_SCHEMA, BAR, BAR_TYPES)
    return done.select("sym", "at", *(F.round(x, 6).alias(x) for x in ("o", "h", "l", "c", "vol")), "n")


def signed(spark, d):
    return ticks(spark, d).withColumn("sign", F.when(C("side") == "buy", 1).otherwise(-1))


@query("dollar_bars")
def dollar_bars(spark, d):
    return info_bars(ticks(spark, d), S.dollar_step(20_000.0), ["price", "qty"])


@query("imbalance_bars")
def imbalance_bars(spark, d):
    return info_bars(signed(spark, d), S.imbalance_step(60.0), ["price", "qty", "sign"])


@query("runs_bars")
def runs_bars(spark, d):
    return info_bars(signed(spark, d), S.runs_step(120.0), ["price", "qty", "sign"])


CUSUM = f"""WITH RECURSIVE {BARS_SQL}, x AS (SELECT sym, i, ln(c) - coalesce(ln(lag(c) OVER (PARTITION BY sym ORDER BY i)), ln(c)) AS dx FROM rets),
 f AS (SELECT sym, i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS side FROM x WHERE i = 1 UNION ALL
 SELECT sym, i, CASE WHEN u >= 0.1 OR w <= -0.1 THEN 0 ELSE u END, CASE WHEN u >= 0.1 OR w <= -0.1 THEN 0 ELSE w END, CASE WHEN u >= 0.1 THEN 1 WHEN w <= -0.1 THEN -1 ELSE 0 END
 FROM (SELECT x.sym, x.i, greatest(0, f.up + x.dx) AS u, least(0, f.down + x.dx) AS w FROM f JOIN x ON x.sym = f.sym AND x.i = f.i + 1))
 SELECT sym, CAST(i AS BIGINT) AS at, CAST(side AS INT) AS side FROM f WHERE side <> 0"""


def filtered(b: DataFrame) -> DataFrame:
    start, step = S.cusum_step(0.1)
    x = b.select("sym", C("i").cast("long").alias("i"), F.log("c").alias("x"))
    return S.fold(x, "sym", ["i"], ["i", "x"], start, step, "sym string, at long, side int", ["sym", "at", "side"], [pa.string(), pa.int64(), pa.int32()])


@query("cusum_events", CUSUM)
def cusum(spark, d):
    return filtered(rets(spark, d))


@query("kalman_level")
def kalman(spark, d):
    start, step = S.kalman_step(0.05, 1.0)
    x = rets(spark, d).select("sym", C("i").cast("long").alias("i"), F.log("c").alias("x"))
    k = S.fold(x, "sym", ["i"], ["i", "x"], start, step, "sym string, at long, level double, variance double", ["sym", "at", "level", "variance"], [pa.string(), pa.int64(), pa.float64(), pa.float64()])
    return out(k, "sym", "at", level=C("level"), variance=C("variance"))


@query("ledger_wac")
def ledger(spark, d):
    start, step = S.ledger_step()
    t = trades(spark, d).select("sym", "d", "l_orderkey", "l_linenumber", "price", F.when(C("side") == "buy", C("qty")).otherwise(-C("qty")).alias("q"))
    k = S.fold(t, "sym", ["d", "l_orderkey", "l_linenumber", "price"], ["l_orderkey", "price", "q"], start, step, "sym string, at long, position double, cost double, realised double", ["sym", "at", "position", "cost", "realised"], [pa.string(), pa.int64(), *[pa.float64()] * 3])
    return k.groupBy("sym").agg(F.count("*").alias("fills"), F.round(F.max("realised"), 2).alias("best"), F.round(F.min("realised"), 2).alias("worst"))


# Labels


@query("fixed_horizon_labels", f"WITH {BARS_SQL}, x AS (SELECT sym, d, lead(c, 10) OVER (PARTITION BY sym ORDER BY d) / c - 1 AS f FROM bars) SELECT sym, d, CASE WHEN f > 0.02 THEN 1 WHEN f < -0.02 THEN -1 WHEN f IS NOT NULL THEN 0 END AS label FROM x")
def fixed_horizon(spark, d):
    f = F.lead("c", 10).over(W.series()) / C("c") - 1
    return bars_1d(spark, d).withColumn("f", f).select("sym", "d", F.when(C("f") > 0.02, 1).when(C("f") < -0.02, -1).when(C("f").isNotNull(), 0).alias("label"))


def triple_barrier(b: DataFrame, width: float, horizon: int, stop_first: bool) -> DataFrame:
    """First touch of close * (1 +- width) within the next horizon bars, from arrays of the frame ahead: no self-join. b: sym, d, i, h, l, c."""
    ahead = Window.partitionBy("sym").orderBy("d").rowsBetween(1, horizon)
    b = b.withColumn("path", F.collect_list(F.struct("h", "l", "c")).over(ahead))
    up = F.transform("path", lambda p: p["h"] >= C("c") * (1 + width))
    down = F.transform("path", lambda p: p["l"] <= C("c") * (1 - width))
    b = b.withColumn("u", F.array_position(up, True)).withColumn("w", F.array_position(down, True)).where(F.size("path") > 0)
    hit = lambda a, o: (C(a) > 0) & ((C(o) == 0) | ((C(a) < C(o)) if (a == "u") == stop_first else (C(a) <= C(o))))
    label = F.when(hit("u", "w"), 1).when(C("w") > 0, -1).otherwise(0)
    steps = F.when(C("u") == 0, C("w")).when(C("w") == 0, C("u")).otherwise(F.least("u", "w"))
    steps = F.when(steps == 0, F.size("path")).otherwise(steps).cast("long")
    last = F.element_at("path", F.size("path"))["c"]
    gain = F.when(label == 1, width).when(label == -1, -width).otherwise(last / C("c") - 1)
    return b.select("sym", "d", label.alias("label"), steps.alias("held"), F.round(gain, 6).alias("gain"))


def _barrier_sql(stop_first: bool) -> str:
    tie = "d.k <= coalesce(u.k, 999)" if stop_first else "d.k < coalesce(u.k, 999)"
    return f"""WITH {BARS_SQL}, j AS (SELECT a.sym, a.d, a.c AS c0, b.i - a.i AS k, b.h, b.l, b.c FROM rets a JOIN rets b ON a.sym = b.sym AND b.i > a.i AND b.i <= a.i + 10),
    u AS (SELECT sym, d, min(k) AS k FROM j WHERE h >= c0 * 1.05 GROUP BY 1, 2), d AS (SELECT sym, d, min(k) AS k FROM j WHERE l <= c0 * 0.95 GROUP BY 1, 2), e AS (SELECT sym, d, max(k) AS k, arg_max(c, k) / any_value(c0) - 1 AS g FROM j GROUP BY 1, 2)
    SELECT e.sym, e.d, CASE WHEN d.k IS NOT NULL AND {tie} THEN -1 WHEN u.k IS NOT NULL THEN 1 ELSE 0 END AS label, CAST(least(coalesce(u.k, 999), coalesce(d.k, 999), e.k) AS BIGINT) AS held,
    round(CASE WHEN d.k IS NOT NULL AND {tie} THEN -0.05 WHEN u.k IS NOT NULL THEN 0.05 ELSE e.g END, 6) AS gain FROM e LEFT JOIN u USING (sym, d) LEFT JOIN d USING (sym, d)"""


@query("triple_barrier_stop_first", _barrier_sql(True))
def barrier_stop(spark, d):
    return triple_barrier(bars_1d(spark, d), 0.05, 10, True)


@query("triple_barrier_profit_first", _barrier_sql(False))
def barrier_profit(spark, d):
    return triple_barrier(bars_1d(spark, d), 0.05, 10, False)


@query(
    "trend_scan",
    f"""WITH {BARS_SQL}, j AS (SELECT a.sym, a.d, n.n, regr_slope(b.c, CAST(b.i AS DOUBLE)) AS s, regr_syy(b.c, CAST(b.i AS DOUBLE)) AS syy, regr_sxx(b.c, CAST(b.i AS DOUBLE)) AS sxx, count(*) AS k
    FROM rets a CROSS JOIN (VALUES (5), (10), (15)) n(n) JOIN rets b ON a.sym = b.sym AND b.i >= a.i AND b.i < a.i + n.n GROUP BY 1, 2, 3 HAVING count(*) = n.n),
    t AS (SELECT sym, d, n, s / sqrt((syy - s * s * sxx) / (n - 2) / sxx) AS t FROM j)
    SELECT sym, d, round(arg_max(t, abs(t)), 4) AS t, CAST(arg_max(n, abs(t)) AS INT) AS span FROM t GROUP BY 1, 2""",
)
def trend_scan(spark, d):
    """The strongest t-value of the slope over the next 5, 10 and 15 closes."""
    b = rets(spark, d).select("sym", "d", "c", C("i").cast("double").alias("i"))
    best = []
    for n in (5, 10, 15):
        f = Window.partitionBy("sym").orderBy("d").rowsBetween(0, n - 1)
        s, syy, sxx = F.regr_slope("c", "i").over(f), F.regr_syy("c", "i").over(f), F.regr_sxx("c", "i").over(f)
        t = s / F.sqrt((syy - s * s * sxx) / (n - 2) / sxx)
        best.append(F.when(F.count("c").over(f) == n, F.struct(F.abs(t).alias("a"), F.lit(-n).alias("n"), t.alias("t"))))
    b = b.withColumn("best", F.array_max(F.array_compact(F.array(*best)))).where("best is not null")
    return b.select("sym", "d", F.round("best.t", 4).alias("t"), (-C("best.n")).alias("span"))


#: Every bar with a return is an event.
EVENTS_SQL = f"{BARS_SQL}, ev AS (SELECT sym, i AS t0, i + 5 + (i % 7) AS t1, r FROM rets WHERE r IS NOT NULL)"


def events(spark, d) -> DataFrame:
    """Every bar with a return."""
    return rets(spark, d).where("r is not null").select("sym", C("i").cast("long").alias("t0"), (C("i") + 5 + C("i") % 7).cast("long").alias("t1"), "r")


@query(
    "average_uniqueness",
    f"WITH {EVENTS_SQL}, x AS (SELECT sym, t0, unnest(generate_series(t0, t1 - 1)) AS t FROM ev), c AS (SELECT sym, t, count(*) AS n FROM x GROUP BY 1, 2) SELECT x.sym, x.t0, round(avg(1.0 / c.n), 6) AS u FROM x JOIN c USING (sym, t) GROUP BY 1, 2",
)
def uniqueness(spark, d):
    return unique(events(spark, d))


def unique(e: DataFrame) -> DataFrame:
    """Concurrency from starts and ends as a running sum; only the events' bars are exploded."""
    x = e.select("sym", "t0", F.explode(F.sequence("t0", C("t1") - 1)).alias("t"))
    c = x.groupBy("sym", "t").agg(F.count("*").alias("n"))
    return x.join(c, ["sym", "t"]).groupBy("sym", "t0").agg(F.round(F.avg(1.0 / C("n")), 6).alias("u"))


@query("sample_weights", f"WITH {EVENTS_SQL}, w AS (SELECT sym, t0, ln(1 + 100 * abs(r)) + 1 AS w, max(t0) OVER (PARTITION BY sym) - t0 AS age FROM ev) SELECT sym, t0, round(least(greatest(w / avg(w) OVER (PARTITION BY sym) * exp(-age / 500.0), 0.05), 10), 6) AS w FROM w")
def sample_weights(spark, d):
    return weighted(events(spark, d))


def weighted(e: DataFrame) -> DataFrame:
    p = Window.partitionBy("sym")
    e = e.withColumn("w", F.log(1 + 100 * F.abs("r")) + 1).withColumn("age", F.max("t0").over(p) - C("t0"))
    return out(e, "sym", "t0", w=F.least(F.greatest(C("w") / F.avg("w").over(p) * F.exp(-C("age") / 500.0), F.lit(0.05)), F.lit(10.0)))


@query(
    "walk_forward_folds",
    f"""WITH {EVENTS_SQL}, k AS (SELECT sym, k, 400 + k * 200 AS a, 600 + k * 200 AS b FROM (SELECT sym, unnest(generate_series(0, (max(i) - 400) // 200)) AS k FROM rets GROUP BY sym HAVING max(i) >= 400))
    SELECT sym, CAST(k AS INT) AS fold, count_if(t1 < a - 10 AND t0 >= a - 400) AS n_train, count_if(t0 >= a AND t0 < b) AS n_test, count_if(t0 < a AND t1 >= a - 10 AND t0 >= a - 400) AS purged FROM ev JOIN k USING (sym) GROUP BY sym, k""",
)
def walk_forward(spark, d):
    """Folds up to the last bar of each series, whose last fold may be short. An event meets only the three folds that it can belong to."""
    last = F.max("i").over(Window.partitionBy("sym"))
    e = rets(spark, d).withColumn("folds", F.floor((last - 400) / 200).cast("int")).where("r is not null")
    e = e.select("sym", C("i").cast("long").alias("t0"), (C("i") + 5 + C("i") % 7).cast("long").alias("t1"), "folds")
    first = F.floor((C("t0") - 400) / 200).cast("int")
    e = e.select("sym", "t0", "t1", "folds", F.explode(F.sequence(first, first + 2)).alias("fold")).where("fold between 0 and folds")
    return fold_counts(e.withColumn("a", 400 + 200 * C("fold")).withColumn("b", C("a") + 200))


def fold_counts(e: DataFrame) -> DataFrame:
    count = lambda x, name: F.count_if(F.expr(x)).alias(name)
    return e.groupBy("sym", "fold").agg(count("t1 < a - 10 and t0 >= a - 400", "n_train"), count("t0 >= a and t0 < b", "n_test"), count("t0 < a and t1 >= a - 10 and t0 >= a - 400", "purged"))


SPLITS = list(combinations(range(6), 2))


@query(
    "cpcv_membership",
    f"""WITH {EVENTS_SQL}, g AS (SELECT *, least(5, t0 * 6 // (max(t0) OVER (PARTITION BY sym) + 1)) AS g FROM ev), s AS (SELECT * FROM (VALUES {", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(SPLITS))}) v(split, a, b)),
    z AS (SELECT sym, g, min(t0) AS lo, max(t1) AS hi FROM g GROUP BY 1, 2)
    SELECT g.sym, CAST(split AS INT) AS split, count_if(g.g = a OR g.g = b) AS n_test, count_if(g.g <> a AND g.g <> b AND NOT (g.t0 <= x.hi + 5 AND g.t1 >= x.lo - 5) AND NOT (g.t0 <= y.hi + 5 AND g.t1 >= y.lo - 5)) AS n_train
    FROM g CROSS JOIN s JOIN z x ON x.sym = g.sym AND x.g = a JOIN z y ON y.sym = g.sym AND y.g = b GROUP BY 1, 2""",
)
def cpcv(spark, d):
    return purged_splits(events(spark, d))


def purged_splits(e: DataFrame) -> DataFrame:
    """Bounds of the six groups as arrays on each event; the 15 splits are a fixed table."""
    p = Window.partitionBy("sym")
    g = e.withColumn("g", F.least(F.lit(5), F.floor(C("t0") * 6 / (F.max("t0").over(p) + 1))).cast("int"))
    z = g.groupBy("sym", "g").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi")).groupBy("sym").agg(F.map_from_entries(F.collect_list(F.struct("g", F.struct("lo", "hi")))).alias("z"))
    s = F.explode(F.array(*(F.struct(F.lit(k).alias("split"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(SPLITS)))).alias("s")
    e = g.join(z, "sym").select("sym", "t0", "t1", "g", "z", s).select("*", "s.*").where(F.element_at("z", C("a")).isNotNull() & F.element_at("z", C("b")).isNotNull())
    clear = lambda x: ~((C("t0") <= F.element_at("z", C(x))["hi"] + 5) & (C("t1") >= F.element_at("z", C(x))["lo"] - 5))
    test = (C("g") == C("a")) | (C("g") == C("b"))
    return e.groupBy("sym", "split").agg(F.count_if(test).alias("n_test"), F.count_if(~test & clear("a") & clear("b")).alias("n_train"))


# Portfolio and risk

WEIGHTS = f"""{BARS_SQL}, v AS (SELECT sym, d, i, r, c, CASE WHEN count(lr) OVER f >= 20 THEN stddev_samp(lr) OVER f END AS s FROM rets {"WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"}),
 w AS (SELECT sym, d, r, s, CASE WHEN s > 0 THEN 1 / s / sum(CASE WHEN s > 0 THEN 1 / s END) OVER (PARTITION BY d) ELSE 0 END AS w FROM v)"""


def inverse_vol(spark, d) -> DataFrame:
    v = rets(spark, d).withColumn("s", W.rolling(C("lr"), "std", 20))
    inverse = F.when(C("s") > 0, 1 / C("s"))
    return v.withColumn("w", F.coalesce(inverse / F.sum(inverse).over(W.cross()), F.lit(0.0)))


@query("w_inverse_vol", f"WITH {WEIGHTS} SELECT sym, d, round(w, 6) AS w FROM w")
def w_inverse_vol(spark, d):
    return out(inverse_vol(spark, d), "sym", "d", w=C("w"))


@query("w_equal", f"WITH {BARS_SQL} SELECT sym, d, round(1.0 / count(*) OVER (PARTITION BY d), 6) AS w FROM bars")
def w_equal(spark, d):
    return out(bars_1d(spark, d), "sym", "d", w=1.0 / F.count("*").over(W.cross()))


SIGNAL = f"{BARS_SQL}, g AS (SELECT sym, d, CASE WHEN r IS NULL THEN 0 ELSE greatest(-1, least(1, 20 * r)) END AS x, CASE WHEN sym < 'NZ' THEN 'a' ELSE 'b' END AS k FROM rets)"


def signal(spark, d) -> DataFrame:
    x = F.when(C("r").isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 20 * C("r"))))
    return rets(spark, d).select("sym", "d", x.alias("x"), F.when(C("sym") < "NZ", "a").otherwise("b").alias("k"))


def _cap(name: str, spark_w, sql_w: str):
    @query(name, f"WITH {SIGNAL} SELECT sym, d, round({sql_w}, 6) + 0.0 AS w FROM g WINDOW p AS (PARTITION BY d)")
    def run(spark, d):
        return out(signal(spark, d), "sym", "d", w=spark_w())


GROSS = lambda: F.sum(F.abs("x")).over(W.cross())
_cap("cap_gross", lambda: C("x") * F.when(GROSS() > 1.5, 1.5 / GROSS()).otherwise(1.0), "x * CASE WHEN sum(abs(x)) OVER p > 1.5 THEN 1.5 / sum(abs(x)) OVER p ELSE 1.0 END")
_cap("normalise_to_gross", lambda: F.when(GROSS() > 0, C("x") / GROSS()).otherwise(0.0), "CASE WHEN sum(abs(x)) OVER p > 0 THEN x / sum(abs(x)) OVER p ELSE 0 END")
_cap("cap_per_asset", lambda: F.greatest(F.lit(-0.25), F.least(F.lit(0.25), C("x"))), "greatest(-0.25, least(0.25, x))")
LONG, SHORT = lambda: F.sum(F.greatest(C("x"), F.lit(0.0))).over(W.cross()), lambda: F.sum(F.greatest(-C("x"), F.lit(0.0))).over(W.cross())
_cap(
    "cap_net", lambda: F.when((C("x") > 0) & (LONG() - SHORT() > 0.3), C("x") * (SHORT() + 0.3) / LONG()).when((C("x") < 0) & (SHORT() - LONG() > 0.3), C("x") * (LONG() + 0.3) / SHORT()).otherwise(C("x")),
    """CASE WHEN x > 0 AND sum(greatest(x, 0)) OVER p - sum(greatest(-x, 0)) OVER p > 0.3 THEN x * (sum(greatest(-x, 0)) OVER p + 0.3) / sum(greatest(x, 0)) OVER p
    WHEN x < 0 AND sum(greatest(-x, 0)) OVER p - sum(greatest(x, 0)) OVER p > 0.3 THEN x * (sum(greatest(x, 0)) OVER p + 0.3) / sum(greatest(-x, 0)) OVER p ELSE x END""",
)


@query("cap_cluster", f"WITH {SIGNAL} SELECT sym, d, round(x * CASE WHEN sum(abs(x)) OVER (PARTITION BY d, k) > 0.6 THEN 0.6 / sum(abs(x)) OVER (PARTITION BY d, k) ELSE 1 END, 6) + 0.0 AS w FROM g")
def cap_cluster(spark, d):
    gross = F.sum(F.abs("x")).over(Window.partitionBy("d", "k"))
    return out(signal(spark, d), "sym", "d", w=C("x") * F.when(gross > 0.6, 0.6 / gross).otherwise(1.0))


@query(
    "concentration_waterfill",
    f"""WITH {SIGNAL}, a AS (SELECT sym, d, x, abs(x) AS m, greatest(0.3, 1.0 / count(*) OVER (PARTITION BY d)) AS cap FROM g), s AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY m DESC, sym) AS k, sum(m) OVER (PARTITION BY d) AS total FROM a),
    t AS (SELECT *, coalesce(total - sum(m) OVER (PARTITION BY d ORDER BY k), total) AS rest FROM s), l AS (SELECT d, min(CASE WHEN 1 - k * cap > 0 THEN cap * rest / (1 - k * cap) END) AS lim, max(total) AS total, max(m) AS top, any_value(cap) AS cap FROM t GROUP BY d)
    SELECT s.sym, s.d, round(CASE WHEN l.top <= l.cap * l.total + 1e-12 OR l.lim IS NULL THEN x ELSE sign(x) * least(m, l.lim) END, 6) + 0.0 AS w FROM s JOIN l USING (d)""",
)
def waterfill(spark, d):
    """The level at which no position exceeds its share of what is left: the least of the levels with the k largest at the cap."""
    x = W.cross()
    a = signal(spark, d).withColumn("m", F.abs("x")).withColumn("cap", F.greatest(F.lit(0.3), 1.0 / F.count("*").over(x))).withColumn("total", F.sum("m").over(x))
    ordered = x.orderBy(C("m").desc(), "sym")
    a = a.withColumn("n", F.row_number().over(ordered)).withColumn("rest", C("total") - F.sum("m").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    limit = F.min(F.when(1 - C("n") * C("cap") > 0, C("cap") * C("rest") / (1 - C("n") * C("cap")))).over(x)
    w = F.when((F.max("m").over(x) <= C("cap") * C("total") + 1e-12) | limit.isNull(), C("x")).otherwise(F.signum("x") * F.least(C("m"), limit))
    return out(a, "sym", "d", w=w)


@query("hold_every_5", f"WITH {SIGNAL}, n AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d) - 1 AS j FROM g) SELECT sym, d, round(first_value(x) OVER (PARTITION BY sym, j // 5 ORDER BY d), 6) + 0.0 AS w FROM n")
def hold(spark, d):
    n = signal(spark, d).withColumn("j", F.floor((F.row_number().over(W.series()) - 1) / 5))
    return out(n, "sym", "d", w=F.first("x").over(Window.partitionBy("sym", "j").orderBy("d")))


@query("turnover", f"WITH {WEIGHTS}, t AS (SELECT d, abs(w - coalesce(lag(w) OVER (PARTITION BY sym ORDER BY d), 0)) AS t FROM w) SELECT d, round(sum(t) / 2, 6) AS turnover FROM t GROUP BY d")
def turnover(spark, d):
    return inverse_vol(spark, d).withColumn("t", F.abs(C("w") - F.coalesce(F.lag("w").over(W.series()), F.lit(0.0)))).groupBy("d").agg(F.round(F.sum("t") / 2, 6).alias("turnover"))


BOOK = f"""{WEIGHTS}, h AS (SELECT sym, d, r, w, lag(w) OVER (PARTITION BY sym ORDER BY d) AS held FROM w),
 p AS (SELECT d, sum(coalesce(held, 0) * coalesce(r, 0)) - 0.0005 * sum(abs(w - coalesce(held, 0))) AS net FROM h GROUP BY d),
 eq AS (SELECT d, net, max(CASE WHEN net <= -1 THEN 1 ELSE 0 END) OVER (ORDER BY d) = 1 AS ruined, CASE WHEN max(CASE WHEN net <= -1 THEN 1 ELSE 0 END) OVER (ORDER BY d) = 0 THEN sum(CASE WHEN net > -1 THEN ln(1 + net) END) OVER (ORDER BY d) END AS le FROM p),
 curve AS (SELECT *, CASE WHEN ruined THEN 1 ELSE 1 - exp(le - max(le) OVER (ORDER BY d)) END AS drawdown FROM eq)"""


def book(spark, d) -> DataFrame:
    """Lagged weights against returns, less costs of trading; one row a day."""
    h = inverse_vol(spark, d).withColumn("held", F.coalesce(F.lag("w").over(W.series()), F.lit(0.0)))
    return h.groupBy("d").agg((F.sum(C("held") * F.coalesce("r", F.lit(0.0))) - 0.0005 * F.sum(F.abs(C("w") - C("held")))).alias("net"))


GROWN = lambda: F.when(C("net") > -1, F.log1p("net"))
RUINED = lambda: (C("net") <= -1).cast("int")


def equity(p: DataFrame) -> DataFrame:
    """Compounds a book's days, month by month, in logs, which can't overflow: le, ruined, drawdown. A day that loses all is ruin: le is null from there on, and the drawdown 1."""
    p = W.running(p, "d", F.trunc("d", "month"), grown=GROWN(), lost=RUINED())
    p = p.withColumn("ruined", C("lost") > 0).withColumn("le", F.when(C("lost") == 0, C("grown")))
    return W.running_max(p, "d", "peak", "le").withColumn("drawdown", F.when(C("ruined"), 1.0).otherwise(1 - F.exp(C("le") - C("peak"))))


@query("book_vectorized", f"WITH {BOOK} SELECT d, round(net, 6) + 0.0 AS net, round(le, 5) + 0.0 AS log_equity, ruined FROM eq")
def book_vectorized(spark, d):
    return equity(book(spark, d)).select("d", (F.round("net", 6) + 0.0).alias("net"), (F.round("le", 5) + 0.0).alias("log_equity"), "ruined")


@query("drawdown_curve", f"WITH {BOOK} SELECT d, round(drawdown, 5) + 0.0 AS drawdown FROM curve")
def drawdown(spark, d):
    return equity(book(spark, d)).select("d", (F.round("drawdown", 5) + 0.0).alias("drawdown"))


YEARLY = f"""WITH {BOOK}, y AS (SELECT *, year(d) AS y, max(CASE WHEN net <= -1 THEN 1 ELSE 0 END) OVER w = 1 AS lost, sum(CASE WHEN net > -1 THEN ln(1 + net) END) OVER w AS l FROM p WINDOW w AS (PARTITION BY year(d) ORDER BY d)),
 z AS (SELECT *, CASE WHEN lost THEN 1 ELSE 1 - exp(l - max(l) OVER (PARTITION BY y ORDER BY d)) END AS dd FROM y)
 SELECT CAST(y AS INT) AS y, count(*) AS n, CASE WHEN min(net) > -1 THEN round(sum(CASE WHEN net > -1 THEN ln(1 + net) END), 5) END AS log_total, round(avg(net) / stddev_samp(net) * sqrt(252.0), 4) AS sharpe, round(max(dd), 5) AS worst FROM z GROUP BY y"""


@query("yearly_metrics", YEARLY)
def yearly(spark, d):
    """By year; a year with a day that loses all has no log_total, and 1 as its worst drawdown."""
    p = book(spark, d).withColumn("y", F.year("d"))
    w = Window.partitionBy("y").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    z = p.withColumn("lost", F.max(RUINED()).over(w) == 1).withColumn("l", F.sum(GROWN()).over(w))
    z = z.withColumn("dd", F.when(C("lost"), 1.0).otherwise(1 - F.exp(C("l") - F.max("l").over(w))))
    total = F.when(F.min("net") > -1, F.round(F.sum(GROWN()), 5))
    return z.groupBy("y").agg(F.count("*").alias("n"), total.alias("log_total"), F.round(F.try_divide(F.avg("net"), F.stddev_samp("net")) * math.sqrt(252), 4).alias("sharpe"), F.round(F.max("dd"), 5).alias("worst"))


@query("period_returns", f"WITH {BARS_SQL} SELECT sym, date_trunc('quarter', d)::DATE AS q, round(exp(sum(ln(1 + r))) - 1, 6) AS total FROM rets WHERE r IS NOT NULL GROUP BY 1, 2")
def period_returns(spark, d):
    return rets(spark, d).where("r is not null").groupBy("sym", F.trunc("d", "quarter").alias("q")).agg(F.round(F.exp(F.sum(F.log1p("r"))) - 1, 6).alias("total"))


@query(
    "book_funding",
    f"WITH {WEIGHTS}, {FUNDING_SQL}, f AS (SELECT sym, d + 1 AS d, sum(rate) AS x FROM funding GROUP BY sym, d), h AS (SELECT sym, d, lag(w) OVER (PARTITION BY sym ORDER BY d) AS held FROM w) SELECT h.sym, round(-sum(held * x) * 1e6, 2) AS paid FROM h JOIN f USING (sym, d) GROUP BY h.sym",
)
def book_funding(spark, d):
    f = funding(spark, d).groupBy("sym", F.date_add("d", 1).alias("d")).agg(F.sum("rate").alias("x"))
    h = inverse_vol(spark, d).select("sym", "d", F.lag("w").over(W.series()).alias("held"))
    return h.join(f, ["sym", "d"]).groupBy("sym").agg(F.round(-F.sum(C("held") * C("x")) * 1e6, 2).alias("paid"))


@query("trend_overlay", f"WITH {BARS_SQL}, s AS (SELECT sym, d, r, CASE WHEN c > avg(c) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) THEN 1 ELSE 0 END AS p FROM rets), h AS (SELECT *, lag(p) OVER (PARTITION BY sym ORDER BY d) AS held FROM s) SELECT sym, round(exp(sum(ln(1 + held * r))) - 1, 5) AS total, sum(held)::BIGINT AS days FROM h WHERE r IS NOT NULL GROUP BY sym")
def trend_overlay(spark, d):
    s = rets(spark, d).withColumn("p", F.when(C("c") > F.avg("c").over(W.trailing(100)), 1).otherwise(0))
    h = s.withColumn("held", F.lag("p").over(W.series())).where("r is not null")
    return h.groupBy("sym").agg(F.round(F.exp(F.sum(F.log1p(C("held") * C("r")))) - 1, 5).alias("total"), F.sum("held").alias("days"))


# Execution


@query("fees_slippage_impact", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * CASE WHEN l_linenumber % 2 = 1 THEN 0.00055 ELSE 0.0002 END, 8) AS fee, round(greatest(0.5, 0.1 * l_quantity) * l_extendedprice / 1e4, 8) AS slippage, round(0.8 * 0.02 * sqrt(l_extendedprice / 5e6) * l_extendedprice, 4) AS impact  FROM lineitem""")
def fees(spark, d):
    x = C("l_extendedprice")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(x * F.when(C("l_linenumber") % 2 == 1, 0.00055).otherwise(0.0002), 8).alias("fee"), F.round(F.greatest(F.lit(0.5), 0.1 * C("l_quantity")) * x / 1e4, 8).alias("slippage"),
        F.round(0.8 * 0.02 * F.sqrt(x / 5e6) * x, 4).alias("impact"),
    )


TCA = f"{TICKS_SQL}, t AS (SELECT *, lag(price) OVER (PARTITION BY sym ORDER BY ts, seq) AS arrival FROM ticks), s AS (SELECT sym, side, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (price / arrival - 1) * 1e4 AS bps FROM t WHERE arrival <> 0)"


def shortfall(spark, d) -> DataFrame:
    """Against the last price before the trade; a trade without one, or behind a price of zero, has no shortfall."""
    t = ticks(spark, d).withColumn("arrival", F.lag("price").over(Window.partitionBy("sym").orderBy("ts", "seq"))).where("arrival <> 0")
    return t.withColumn("bps", F.when(C("side") == "buy", 1).otherwise(-1) * (F.try_divide("price", "arrival") - 1) * 1e4)


@query("tca_by_symbol", f"WITH {TCA} SELECT sym, count(*) AS n, round(avg(bps), 3) AS mean, round(quantile_cont(bps, 0.5), 4) AS median, round(avg(CASE WHEN bps > 0 THEN 1.0 ELSE 0 END), 6) AS worse FROM s GROUP BY sym")
def tca(spark, d):
    return shortfall(spark, d).groupBy("sym").agg(F.count("*").alias("n"), F.round(F.avg("bps"), 3).alias("mean"), F.round(F.percentile("bps", 0.5), 4).alias("median"), F.round(F.avg((C("bps") > 0).cast("double")), 6).alias("worse"))


@query("tca_by_side", f"WITH {TCA} SELECT sym, side, count(*) AS n, round(avg(bps), 3) AS mean FROM s GROUP BY ALL")
def tca_side(spark, d):
    return shortfall(spark, d).groupBy("sym", "side").agg(F.count("*").alias("n"), F.round(F.avg("bps"), 3).alias("mean"))


# Statistics


def _stat(name: str, sql: str, *values):
    @query(name, f"WITH {BARS_SQL} SELECT sym, {sql} FROM rets WHERE r IS NOT NULL GROUP BY sym")
    def run(spark, d):
        return rets(spark, d).where("r is not null").groupBy("sym").agg(*(x() for x in values))


_v = lambda name, x, digits=5: lambda: F.round(x(), digits).alias(name)
_stat("sharpe", "round(avg(r) / stddev_samp(r) * sqrt(252.0), 5) AS sharpe, round(stddev_samp(r) * sqrt(252.0), 5) AS vol", _v("sharpe", lambda: F.avg("r") / F.stddev_samp("r") * math.sqrt(252)), _v("vol", lambda: F.stddev_samp("r") * math.sqrt(252)))
_stat(
    "sharpe_standard_error", "round(sqrt((1 + (avg(r) / stddev_samp(r)) ** 2 / 2 - skewness_pop(r) * avg(r) / stddev_samp(r) + kurtosis_pop(r) / 4 * (avg(r) / stddev_samp(r)) ** 2) / (count(*) - 1)), 6) AS se".replace("skewness_pop(r)", "((avg(r ** 3) - 3 * avg(r) * avg(r ** 2) + 2 * avg(r) ** 3) / stddev_pop(r) ** 3)"),
    _v("se", lambda: F.sqrt((1 + (F.avg("r") / F.stddev_samp("r")) ** 2 / 2 - F.skewness("r") * F.avg("r") / F.stddev_samp("r") + F.kurtosis("r") / 4 * (F.avg("r") / F.stddev_samp("r")) ** 2) / (F.count("*") - 1)), 6),
)
_stat("sortino", "round(avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252.0), 5) AS sortino", _v("sortino", lambda: F.avg("r") / F.stddev_samp(F.when(C("r") < 0, C("r"))) * math.sqrt(252)))
_stat("historical_var", "round(-quantile_cont(r, 0.05), 6) AS var95, round(-quantile_cont(r, 0.01), 6) AS var99", _v("var95", lambda: -F.percentile("r", 0.05), 6), _v("var99", lambda: -F.percentile("r", 0.01), 6))
_stat("annualised_return", "round(exp(sum(ln(1 + r)) * 252.0 / count(*)) - 1, 5) AS annual", _v("annual", lambda: F.exp(F.sum(F.log1p("r")) * 252 / F.count("*")) - 1))


@query("historical_cvar", f"WITH {BARS_SQL}, q AS (SELECT sym, quantile_cont(r, 0.05) AS q FROM rets GROUP BY sym) SELECT sym, round(-avg(r), 6) AS cvar FROM rets JOIN q USING (sym) WHERE r <= q GROUP BY sym")
def cvar(spark, d):
    q = rets(spark, d).groupBy("sym").agg(F.percentile("r", 0.05).alias("q"))
    return rets(spark, d).join(q, "sym").where("r <= q").groupBy("sym").agg(F.round(-F.avg("r"), 6).alias("cvar"))


PAIR = f"{BARS_SQL}, s AS (SELECT sym, r, i <= 600 AS old FROM rets WHERE r IS NOT NULL)"


def halves(spark, d) -> DataFrame:
    return rets(spark, d).where("r is not null").select("sym", "r", (C("i") <= 600).alias("old"))


@query(
    "psi",
    f"""WITH {PAIR}, b AS (SELECT sym, min(r) AS lo, max(r) AS hi FROM s WHERE old GROUP BY sym), k AS (SELECT s.sym, old, least(9, greatest(0, floor((r - lo) / (hi - lo) * 10))) AS bin FROM s JOIN b USING (sym)),
    n AS (SELECT sym, bin, count_if(old) AS a, count_if(NOT old) AS b FROM k GROUP BY 1, 2), p AS (SELECT sym, greatest(a / sum(a) OVER (PARTITION BY sym), 1e-9) AS a, greatest(b / sum(b) OVER (PARTITION BY sym), 1e-9) AS b FROM n)
    SELECT sym, round(sum((b - a) * ln(b / a)), 5) AS psi FROM p GROUP BY sym""",
)
def psi(spark, d):
    h = halves(spark, d)
    b = h.where("old").groupBy("sym").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    k = h.join(b, "sym").withColumn("bin", F.least(F.lit(9), F.greatest(F.lit(0), F.floor((C("r") - C("lo")) / (C("hi") - C("lo")) * 10))))
    n = k.groupBy("sym", "bin").agg(F.count_if("old").alias("a"), F.count_if(~C("old")).alias("b"))
    p = Window.partitionBy("sym")
    share = lambda c: F.greatest(C(c) / F.sum(c).over(p), F.lit(1e-9))
    n = n.select("sym", share("a").alias("a"), share("b").alias("b"))
    return n.groupBy("sym").agg(F.round(F.sum((C("b") - C("a")) * F.log(C("b") / C("a"))), 5).alias("psi"))


CDF = f"""WITH {PAIR}, v AS (SELECT sym, r, count_if(old) AS a, count_if(NOT old) AS b FROM s GROUP BY 1, 2), c AS (SELECT sym, r, sum(a) OVER w / sum(a) OVER p AS x, sum(b) OVER w / sum(b) OVER p AS y, lead(r) OVER w - r AS gap FROM v WINDOW w AS (PARTITION BY sym ORDER BY r), p AS (PARTITION BY sym))"""


def cdfs(spark, d) -> DataFrame:
    v = halves(spark, d).groupBy("sym", "r").agg(F.count_if("old").alias("a"), F.count_if(~C("old")).alias("b"))
    w, p = Window.partitionBy("sym").orderBy("r"), Window.partitionBy("sym")
    return v.select("sym", "r", (F.sum("a").over(w) / F.sum("a").over(p)).alias("x"), (F.sum("b").over(w) / F.sum("b").over(p)).alias("y"), (F.lead("r").over(w) - C("r")).alias("gap"))


@query("ks_drift", CDF + " SELECT sym, round(max(abs(x - y)), 6) AS ks FROM c GROUP BY sym")
def ks(spark, d):
    return cdfs(spark, d).groupBy("sym").agg(F.round(F.max(F.abs(C("x") - C("y"))), 6).alias("ks"))


@query("wasserstein_drift", CDF + " SELECT sym, round(sum(abs(x - y) * gap), 6) AS w1 FROM c GROUP BY sym")
def wasserstein(spark, d):
    return cdfs(spark, d).groupBy("sym").agg(F.round(F.sum(F.abs(C("x") - C("y")) * C("gap")), 6).alias("w1"))


PREDICTIONS = "preds AS (SELECT l.doc_id, CAST(l.quality AS INT) AS y, (d.n_chars % 1000) / 1000.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id))"


def predictions(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", ((C("n_chars") % 1000) / 1000.0).alias("p"))
    return table(spark, d, "labels").select("doc_id", C("quality").cast("int").alias("y")).join(docs, "doc_id")


@query("reliability_bins", f"WITH {PREDICTIONS} SELECT CAST(least(9, floor(p * 10)) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy FROM preds GROUP BY 1")
def reliability(spark, d):
    return predictions(spark, d).groupBy(F.least(F.lit(9), F.floor(C("p") * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("confidence"), F.round(F.avg("y"), 6).alias("accuracy"))


@query("expected_calibration_error", f"WITH {PREDICTIONS}, b AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM preds GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def ece(spark, d):
    b = predictions(spark, d).groupBy(F.least(F.lit(9), F.floor(C("p") * 10)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg("y").alias("a"))
    return b.agg(F.round(F.sum(C("n") * F.abs(C("a") - C("c"))) / F.sum("n"), 6).alias("ece"))


@query(
    "weighted_auc",
    f"WITH {PREDICTIONS}, g AS (SELECT p, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS a, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS b FROM (SELECT *, 1 + doc_id % 3 AS w FROM preds) GROUP BY p), c AS (SELECT *, coalesce(sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(a * (below + b / 2.0)) / (sum(a) * sum(b)), 6) AS auc FROM c",
)
def auc(spark, d):
    """Over distinct scores, each row with its weight; ties count half. Scores are summed up by hundredths first."""
    w = lambda y: F.sum(F.when(C("y") == y, 1 + C("doc_id") % 3).otherwise(0)).cast("double")
    g = predictions(spark, d).groupBy("p").agg(w(1).alias("a"), w(0).alias("b"))
    g = W.running(g, "p", F.floor(C("p") * 100), upto=C("b"))
    return g.agg(F.round(F.try_divide(F.sum(C("a") * (C("upto") - C("b") / 2)), F.sum("a") * F.sum("b")), 6).alias("auc"))


@query("correlation_matrix", f"WITH {BARS_SQL} SELECT a.sym AS x, b.sym AS y, round(corr(a.r, b.r), 5) AS corr, count(*) AS n FROM rets a JOIN rets b ON a.d = b.d AND a.sym < b.sym WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL")
def correlations(spark, d):
    """Each day's symbols as one map, so that pairs form within a row; symbols are few, days many."""
    a = rets(spark, d).where("r is not null").select("sym", "d", "r")
    day = a.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("sym", "r"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y["sym"] > x["sym"]), lambda y: F.struct(x["sym"].alias("x"), y["sym"].alias("y"), x["r"].alias("u"), y["r"].alias("v")))))
    return day.select(F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(F.round(F.corr("p.u", "p.v"), 5).alias("corr"), F.count("*").alias("n"))


@query("qlike_losses", f"WITH {BARS_SQL}, e AS (SELECT sym, lr * lr + 1e-8 AS v, avg(lr * lr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) + 1e-8 AS f, i FROM rets) SELECT sym, round(avg(v / f - ln(v / f) - 1), 4) AS qlike, round(regr_slope(v, f), 5) AS mz_slope, round(regr_r2(v, f), 5) AS mz_r2 FROM e WHERE i > 21 GROUP BY sym")
def qlike(spark, d):
    f = W.series().rowsBetween(-20, -1)
    e = rets(spark, d).select("sym", "i", (C("lr") ** 2 + 1e-8).alias("v"), (F.avg(C("lr") ** 2).over(f) + 1e-8).alias("f")).where("i > 21")
    return e.groupBy("sym").agg(F.round(F.avg(C("v") / C("f") - F.log(C("v") / C("f")) - 1), 4).alias("qlike"), F.round(F.regr_slope("v", "f"), 5).alias("mz_slope"), F.round(F.regr_r2("v", "f"), 5).alias("mz_r2"))


@query("information_coefficient", f"""WITH {BARS_SQL}, s AS (SELECT sym, d, r AS x, lead(r) OVER (PARTITION BY sym ORDER BY d) AS y FROM rets), k AS (SELECT d, rank() OVER (PARTITION BY d ORDER BY x) + (count(*) OVER (PARTITION BY d, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY d ORDER BY y) + (count(*) OVER (PARTITION BY d, y) - 1) / 2.0 AS b FROM s WHERE x IS NOT NULL AND y IS NOT NULL)
    SELECT d, count(*) AS n, round(corr(a, b), 5) AS ic FROM k GROUP BY d HAVING count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0""")
def ic(spark, d):
    s = rets(spark, d).select("sym", "d", C("r").alias("x"), F.lead("r").over(W.series()).alias("y")).where("x is not null and y is not null")
    p = Window.partitionBy("d")
    k = s.select("d", W.rank_average(C("x"), p).alias("a"), W.rank_average(C("y"), p).alias("b"))
    return k.groupBy("d").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 5).alias("ic"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb")).where("n >= 3 and sa > 0 and sb > 0").select("d", "n", "ic")


@query("kelly_fractions", f"WITH {BARS_SQL} SELECT sym, round(greatest(0, least(2, avg(r) / var_samp(r) / 4)), 5) + 0.0 AS kelly FROM rets WHERE r IS NOT NULL GROUP BY sym")
def kelly(spark, d):
    return rets(spark, d).where("r is not null").groupBy("sym").agg((F.round(F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.avg("r") / F.var_samp("r") / 4)), 5) + 0.0).alias("kelly"))


@query("drawdown_breaker")
def drawdown_breaker(spark, d):
    start, step = S.breaker_step(0.2, 0.1)
    e = rets(spark, d).where("r is not null").select("sym", C("i").cast("long").alias("i"), F.exp(F.sum(F.log1p("r")).over(W.expanding())).alias("e"))
    k = S.fold(e, "sym", ["i"], ["i", "e"], start, step, "sym string, at long, drawdown double, halted boolean", ["sym", "at", "drawdown", "halted"], [pa.string(), pa.int64(), pa.float64(), pa.bool_()])
    return k.select("sym", "at", F.round("drawdown", 6).alias("drawdown"), "halted")
