"""Labels with costs, splits and resampling, signals, portfolio rules, risk and execution."""

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
from tidemark.plans.features import rets
from tidemark.plans.panels import decayed, ewm_sql, masks, w
from tidemark.plans.registry import out, query
from tidemark.plans.research import EVENTS_SQL, SIGNAL, TCA, WEIGHTS, events, inverse_vol, shortfall, signal
from tidemark.sources.tables import BARS_SQL, FUNDING_SQL, SYMBOLS, bars_1d, funding, table, ticks

C = F.col

# Events and labels


def directional_step(up: float, down: float):
    """Sums on either side with a threshold of their own; a side restarts alone: (time, side)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, x = row
        change = x - s["last"] if s["last"] is not None else 0.0
        s["last"] = x
        s["up"], s["down"] = max(0.0, s["up"] + change), min(0.0, s["down"] + change)
        found = []
        if s["up"] >= up:
            s["up"] = 0.0
            found.append((at, 1))
        if s["down"] <= -down:
            s["down"] = 0.0
            found.append((at, -1))
        return found

    return lambda: {"last": None, "up": 0.0, "down": 0.0}, step


def _sided(name: str, up: float, down: float):
    sql = f"""WITH RECURSIVE {BARS_SQL}, x AS (SELECT sym, i, ln(c) - coalesce(ln(lag(c) OVER (PARTITION BY sym ORDER BY i)), ln(c)) AS dx FROM rets),
    f AS (SELECT sym, i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, false AS hu, false AS hd FROM x WHERE i = 1 UNION ALL
    SELECT sym, i, CASE WHEN u >= {up} THEN 0 ELSE u END, CASE WHEN w <= -{down} THEN 0 ELSE w END, u >= {up}, w <= -{down} FROM (SELECT x.sym, x.i, greatest(0, f.up + x.dx) AS u, least(0, f.down + x.dx) AS w FROM f JOIN x ON x.sym = f.sym AND x.i = f.i + 1))
    SELECT sym, CAST(i AS BIGINT) AS at, 1 AS side FROM f WHERE hu UNION ALL SELECT sym, CAST(i AS BIGINT), -1 FROM f WHERE hd"""

    @query(name, sql)
    def run(spark, d):
        x = rets(spark, d).select("sym", C("i").cast("long").alias("i"), F.log("c").alias("x"))
        return S.fold(x, "sym", ["i"], ["i", "x"], *directional_step(up, down), "sym string, at long, side int", ["sym", "at", "side"], [pa.string(), pa.int64(), pa.int32()])


_sided("cusum_directional", 0.4, 0.4)
_sided("cusum_for_short", 0.8, 0.3)


@query("calibrated_threshold")
def calibrated_threshold(spark, d):
    """The threshold of a grid whose events come nearest to one a week; the grid is a fixed table beside the series."""
    grid = F.explode(F.array(*(F.lit(k) for k in (1.0, 2.0, 4.0, 8.0))))
    b = rets(spark, d)
    weeks = b.groupBy("sym").agg((F.datediff(F.max("d"), F.min("d")) / 7.0).alias("weeks"))
    x = b.select("sym", "i", F.log("c").alias("x"), grid.alias("k")).select(F.concat_ws("|", "sym", "k").alias("key"), C("i").cast("long").alias("i"), (C("x") / C("k")).alias("x"))
    found = S.fold(x, "key", ["i"], ["i", "x"], *S.cusum_step(0.5), "key string, at long, side int", ["key", "at", "side"], [pa.string(), pa.int64(), pa.int32()])
    n = found.groupBy("key").agg(F.count("*").alias("n")).select(F.split("key", "\\|")[0].alias("sym"), F.split("key", "\\|")[1].cast("double").alias("k"), "n")
    r = n.join(weeks, "sym").withColumn("rate", C("n") / C("weeks"))
    return r.groupBy("sym").agg(F.min_by("k", F.struct(F.abs(C("rate") - 1), "k")).alias("k"), F.round(F.min_by("rate", F.struct(F.abs(C("rate") - 1), "k")), 6).alias("rate"))


FILLS = f"""{BARS_SQL}, j AS (SELECT a.sym, a.d, a.c AS c0, b.i - a.i AS k, b.o, b.h, b.l, b.c FROM rets a JOIN rets b ON a.sym = b.sym AND b.i > a.i AND b.i <= a.i + 10),
 t AS (SELECT *, CASE WHEN l <= c0 * 0.95 THEN -1 WHEN h >= c0 * 1.05 THEN 1 ELSE 0 END AS side FROM j), x AS (SELECT sym, d, min(CASE WHEN side <> 0 THEN k END) AS k, max(k) AS n FROM t GROUP BY sym, d),
 fl AS (SELECT t.sym, t.d, t.side, t.k AS held, CASE t.side WHEN -1 THEN least(o, c0 * 0.95) * 0.999 WHEN 1 THEN greatest(o, c0 * 1.05) ELSE c END / c0 - 1 AS ret FROM t JOIN x ON x.sym = t.sym AND x.d = t.d AND t.k = coalesce(x.k, x.n))"""


def fills(spark, d) -> DataFrame:
    """Exits of the barriers at their level, at the open where it lies beyond it, stops with ten basis points of slippage."""
    b = bars_1d(spark, d)
    ahead = W.series().rowsBetween(1, 10)
    b = b.withColumn("path", F.collect_list(F.struct("o", "h", "l", "c")).over(ahead)).where(F.size("path") > 0)
    low, high = C("c") * 0.95, C("c") * 1.05
    hit = F.array_position(F.transform("path", lambda p: (p["l"] <= low) | (p["h"] >= high)), True)
    b = b.withColumn("held", F.when(hit > 0, hit).otherwise(F.size("path")).cast("long")).withColumn("x", F.element_at("path", C("held").cast("int")))
    side = F.when(C("x")["l"] <= low, -1).when(C("x")["h"] >= high, 1).otherwise(0)
    price = F.when(side == -1, F.least(C("x")["o"], low) * 0.999).when(side == 1, F.greatest(C("x")["o"], high)).otherwise(C("x")["c"])
    return b.select("sym", "d", side.alias("side"), "held", (price / C("c") - 1).alias("ret"))


@query("barrier_fills", f"WITH {FILLS} SELECT sym, d, side, held, round(ret, 6) AS ret FROM fl")
def barrier_fills(spark, d):
    return fills(spark, d).select("sym", "d", "side", "held", F.round("ret", 6).alias("ret"))


TREND = f"""{BARS_SQL}, tj AS (SELECT a.sym, a.d, n.n, regr_slope(b.c, CAST(b.i AS DOUBLE)) AS s, regr_syy(b.c, CAST(b.i AS DOUBLE)) AS syy, regr_sxx(b.c, CAST(b.i AS DOUBLE)) AS sxx, count(*) AS k
 FROM rets a CROSS JOIN (SELECT unnest(generate_series(5, 20)) AS n) n JOIN rets b ON a.sym = b.sym AND b.i >= a.i AND b.i < a.i + n.n GROUP BY 1, 2, 3 HAVING count(*) = n.n),
 tt AS (SELECT sym, d, n, s / sqrt((syy - s * s * sxx) / (n - 2) / sxx) AS t FROM tj), best AS (SELECT sym, d, arg_max(t, abs(t)) AS t, arg_max(n, abs(t)) AS span FROM tt GROUP BY 1, 2)"""


def trends(spark, d) -> DataFrame:
    """The strongest t-value of the slope over the next 5 to 20 closes."""
    b = rets(spark, d).select("sym", "d", "c", C("i").cast("double").alias("i"))
    best = []
    for n in range(5, 21):
        f = W.series().rowsBetween(0, n - 1)
        s, syy, sxx = F.regr_slope("c", "i").over(f), F.regr_syy("c", "i").over(f), F.regr_sxx("c", "i").over(f)
        t = F.try_divide(s, F.sqrt((syy - s * s * sxx) / (n - 2) / sxx))
        best.append(F.when(F.count("c").over(f) == n, F.struct(F.abs(t).alias("a"), F.lit(-n).alias("n"), t.alias("t"))))
    b = b.withColumn("best", F.array_max(F.array_compact(F.array(*best)))).where("best is not null")
    return b.select("sym", "d", C("best.t").alias("t"), (-C("best.n")).alias("span"))


@query("trend_scan_all_spans", f"WITH {TREND} SELECT sym, d, round(t, 4) AS t, CAST(span AS INT) AS span FROM best")
def trend_scan_all(spark, d):
    return trends(spark, d).select("sym", "d", F.round("t", 4).alias("t"), "span")


@query("trend_barrier_labels", f"WITH {TREND}, {FILLS.removeprefix(BARS_SQL + ', ')} SELECT sym, d, CASE WHEN abs(t) >= 3 AND side = sign(t) THEN 1 ELSE 0 END AS label, round(ret, 6) AS ret FROM best JOIN fl USING (sym, d)")
def trend_barrier_labels(spark, d):
    """1 where a clear trend and the barrier that was touched first agree."""
    x = trends(spark, d).join(fills(spark, d), ["sym", "d"])
    return x.select("sym", "d", F.when((F.abs("t") >= 3) & (C("side") == F.signum("t")), 1).otherwise(0).alias("label"), F.round("ret", 6).alias("ret"))


SCOUT = f"{FILLS}, {ewm_sql('fa', 'c', 2 / 11)}, {ewm_sql('sl', 'c', 2 / 41)}, sc AS (SELECT r.sym, r.d, CASE WHEN fa.v > sl.v THEN 1 ELSE -1 END AS side FROM rets r JOIN fa USING (sym, i) JOIN sl USING (sym, i) WHERE r.i > 41 AND abs(r.r) > 0.5)"


def scout(spark, d) -> DataFrame:
    """Large moves, with the side of the fast mean against the slow one; nothing ahead of the bar is used."""
    b = rets(spark, d).select("sym", "i", "d", "c", "r")
    b = decayed(b, fast=("c", 2 / 11), slow=("c", 2 / 41)).where("i > 41 and abs(r) > 0.5")
    return b.select("sym", "d", F.when(C("fast") > C("slow"), 1).otherwise(-1).alias("side"))


@query("causal_scout", f"WITH {SCOUT} SELECT sc.sym, sc.d, sc.side, round(sc.side * fl.ret, 6) AS ret FROM sc JOIN fl USING (sym, d)")
def causal_scout(spark, d):
    x = scout(spark, d).join(fills(spark, d).select("sym", "d", "ret"), ["sym", "d"])
    return x.select("sym", "d", "side", F.round(C("side") * C("ret"), 6).alias("ret"))


@query("primary_scout", f"WITH {TREND}, {FILLS.removeprefix(BARS_SQL + ', ')} SELECT r.sym, r.d, CAST(sign(best.t) AS INT) AS side, round(sign(best.t) * fl.ret, 6) AS ret FROM rets r JOIN best USING (sym, d) JOIN fl USING (sym, d) WHERE abs(r.r) > 0.5")
def primary_scout(spark, d):
    """The side of the trend ahead: it looks ahead, so for research alone."""
    x = rets(spark, d).where("abs(r) > 0.5").select("sym", "d").join(trends(spark, d), ["sym", "d"]).join(fills(spark, d).select("sym", "d", "ret"), ["sym", "d"])
    return x.select("sym", "d", F.signum("t").cast("int").alias("side"), F.round(F.signum("t") * C("ret"), 6).alias("ret"))


def assert_causal(side: DataFrame, cut: DataFrame, keys: list[str]) -> None:
    """A scout gives the same sides when all bars behind the compared ones are gone; raises where it doesn't."""
    if not cut.exceptAll(side.join(cut.select(*keys), keys, "left_semi").select(*cut.columns)).isEmpty():
        raise ValueError("the sides depend on later bars")


@query("meta_labels", f"WITH {SCOUT}, {FUNDING_SQL}, fu AS (SELECT sym, d, sum(rate) AS rate FROM funding GROUP BY ALL) SELECT sc.sym, sc.d, CASE WHEN sc.side * fl.ret - sc.side * coalesce(fu.rate, 0) > 0.001 THEN 1 ELSE 0 END AS meta FROM sc JOIN fl USING (sym, d) LEFT JOIN fu USING (sym, d)")
def meta_labels(spark, d):
    return meta(spark, d).select("sym", "d", "meta")


def meta(spark, d) -> DataFrame:
    """1 where the scout's return, less the funding that its side pays, is a profit."""
    fu = funding(spark, d).groupBy("sym", "d").agg(F.sum("rate").alias("rate"))
    x = scout(spark, d).join(fills(spark, d).select("sym", "d", "ret"), ["sym", "d"]).join(fu, ["sym", "d"], "left")
    net = C("side") * C("ret") - C("side") * F.coalesce("rate", F.lit(0.0))
    return x.withColumn("meta", (net > 0.001).cast("int"))


@query("meta_dataset", f"WITH {SCOUT}, v AS (SELECT sym, d, stddev_samp(lr) OVER f AS s, count(lr) OVER f AS n FROM rets {w(20)}) SELECT sc.sym, count(*) AS n, sum(CASE WHEN sc.side * fl.ret > 0.001 THEN 1 ELSE 0 END)::BIGINT AS positive, round(avg(v.s), 6) AS mean_vol FROM sc JOIN fl USING (sym, d) JOIN v USING (sym, d) WHERE v.n >= 20 AND sc.d < DATE '1999-06-01' GROUP BY sc.sym")
def meta_dataset(spark, d):
    """Features, labels and the training rows alone, summed up by series."""
    v = rets(spark, d).withColumn("s", W.rolling(C("lr"), "std", 20)).where("s is not null").select("sym", "d", "s")
    x = scout(spark, d).join(fills(spark, d).select("sym", "d", "ret"), ["sym", "d"]).join(v, ["sym", "d"]).where("d < date'1999-06-01'")
    return x.groupBy("sym").agg(F.count("*").alias("n"), F.sum((C("side") * C("ret") > 0.001).cast("int")).alias("positive"), F.round(F.avg("s"), 6).alias("mean_vol"))


@query("batch_decisions", "SELECT l.doc_id, CASE WHEN (d.n_chars % 1000) / 1000.0 >= 0.55 THEN CASE WHEN l.quality = 1 THEN 1 ELSE -1 END ELSE 0 END AS side FROM labels l JOIN documents d USING (doc_id)")
def batch_decisions(spark, d):
    """The scout's side where the judge is sure enough, else none."""
    p = table(spark, d, "documents").select("doc_id", ((C("n_chars") % 1000) / 1000.0).alias("p"))
    x = table(spark, d, "labels").join(p, "doc_id")
    return x.select("doc_id", F.when(C("p") >= 0.55, F.when(C("quality") == 1, 1).otherwise(-1)).otherwise(0).alias("side"))


# Splits and resampling


@query("dynamic_embargo", f"WITH {EVENTS_SQL} SELECT sym, CAST(greatest(5, ceil(max(t1 - t0) * 1.5)) AS INT) AS embargo FROM ev GROUP BY sym")
def dynamic_embargo(spark, d):
    return events(spark, d).groupBy("sym").agg(F.greatest(F.lit(5), F.ceil(F.max(C("t1") - C("t0")) * 1.5)).cast("int").alias("embargo"))


@query("purged_training_index", f"WITH {EVENTS_SQL} SELECT sym, count_if(t0 >= 200 AND t0 < 990 AND t1 < 1000) AS n_train, count_if(t0 >= 200 AND t0 < 990 AND t1 >= 1000) AS purged, count_if(t0 >= 990 AND t0 < 1000) AS embargoed FROM ev GROUP BY sym")
def purged_training_index(spark, d):
    """Of a fold that tests from bar 1,000: what trains, what is purged by its exit, what the embargo takes."""
    n = lambda x, name: F.count_if(F.expr(x)).alias(name)
    return events(spark, d).groupBy("sym").agg(n("t0 >= 200 and t0 < 990 and t1 < 1000", "n_train"), n("t0 >= 200 and t0 < 990 and t1 >= 1000", "purged"), n("t0 >= 990 and t0 < 1000", "embargoed"))


@query("fold_uniqueness", f"WITH {EVENTS_SQL}, e AS (SELECT * FROM ev WHERE t0 < 1000 AND t1 < 1000), x AS (SELECT sym, t0, unnest(generate_series(t0, t1 - 1)) AS t FROM e), c AS (SELECT sym, t, count(*) AS n FROM x GROUP BY 1, 2) SELECT x.sym, x.t0, round(avg(1.0 / c.n), 6) AS u FROM x JOIN c USING (sym, t) GROUP BY 1, 2")
def fold_uniqueness(spark, d):
    """Uniqueness among the training events of a fold alone."""
    from tidemark.plans.research import unique

    return unique(events(spark, d).where("t0 < 1000 and t1 < 1000"))


@query("time_splits", f"WITH {BARS_SQL}, n AS (SELECT sym, max(i) AS n FROM rets GROUP BY sym), k AS (SELECT sym, k, k * n // 5 AS a, (k + 1) * n // 5 AS b FROM n, (SELECT unnest(generate_series(0, 4)) AS k)) SELECT r.sym, CAST(k AS INT) AS fold, count_if(i > a AND i <= b) AS n_test, count_if(i <= a - 10 OR i > b + 10) AS n_train FROM rets r JOIN k USING (sym) GROUP BY r.sym, k")
def time_splits(spark, d):
    """Five runs of each series; training leaves ten bars around a test run out."""
    b = rets(spark, d).select("sym", "i", F.max("i").over(Window.partitionBy("sym")).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    lo, hi = F.floor(C("fold") * C("n") / 5), F.floor((C("fold") + 1) * C("n") / 5)
    return b.groupBy("sym", "fold").agg(F.count_if((C("i") > lo) & (C("i") <= hi)).alias("n_test"), F.count_if((C("i") <= lo - 10) | (C("i") > hi + 10)).alias("n_train"))


@query("fold_overlaps", f"WITH {EVENTS_SQL}, k AS (SELECT unnest(generate_series(0, 4)) AS k) SELECT sym, CAST(k AS INT) AS fold, count_if(t0 < 400 + 200 * k - 20 AND t1 >= 400 + 200 * k) AS overlaps FROM ev, k GROUP BY sym, k")
def fold_overlaps(spark, d):
    """Training events of each fold that reach into its test run: none, if the split is sound."""
    e = events(spark, d).select("sym", "t0", "t1", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    a = 400 + 200 * C("fold")
    return e.groupBy("sym", "fold").agg(F.count_if((C("t0") < a - 20) & (C("t1") >= a)).alias("overlaps"))


def return_paths(groups: int, k: int = 2) -> list[list[tuple[int, ...]]]:
    """All ways to part the groups into folds of k groups each: the full paths that combinatorial splits give."""
    def parted(left: tuple[int, ...]):
        if not left:
            yield []
            return
        from itertools import combinations

        for rest in combinations(left[1:], k - 1):
            fold = (left[0], *rest)
            for more in parted(tuple(x for x in left if x not in fold)):
                yield [fold, *more]

    return list(parted(tuple(range(groups))))


PATHS = return_paths(6)


@query("cpcv_return_paths", f"""WITH {EVENTS_SQL}, g AS (SELECT sym, r, least(5, t0 * 6 // (max(t0) OVER (PARTITION BY sym) + 1)) AS g FROM ev), s AS (SELECT sym, g, sum(ln(1 + r)) AS x, count(*) AS n FROM g GROUP BY ALL),
 p AS (SELECT * FROM (VALUES {", ".join(f"({i}, {g}, {a * 10 + b})" for i, path in enumerate(PATHS) for a, b in path for g in (a, b))}) v(path, g, fold)) SELECT sym, CAST(path AS INT) AS path, round(sum(x + fold * 1e-6 * n), 5) AS total FROM s JOIN p USING (g) GROUP BY sym, path""")
def cpcv_return_paths(spark, d):
    """Of each path the sum of its folds' results; a fold's model moves each result by a trace of its number."""
    p = Window.partitionBy("sym")
    g = events(spark, d).select("sym", "r", F.least(F.lit(5), F.floor(C("t0") * 6 / (F.max("t0").over(p) + 1))).cast("int").alias("g"))
    s = g.groupBy("sym", "g").agg(F.sum(F.log1p("r")).alias("x"), F.count("*").alias("n"))
    paths = spark.createDataFrame([(i, x, a * 10 + b) for i, path in enumerate(PATHS) for a, b in path for x in (a, b)], "path int, g int, fold int")
    return s.join(F.broadcast(paths), "g").groupBy("sym", "path").agg(F.round(F.sum(C("x") + C("fold") * 1e-6 * C("n")), 5).alias("total"))  # a fixed table


def _replicates(name: str, columns: list[str], make, n: int = 100):
    """Seeded replicates over the events of one series, dealt out by number."""

    @query(name)
    def run(spark, d):
        ship(spark)
        ids = spark.range(n)

        def go(batches):
            for batch in batches:
                rows = [(i, *make(np.random.default_rng([11, i]))) for i in batch.column("id").to_pylist()]
                yield pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], ["id", *columns])

        return ids.mapInArrow(go, "id long, " + ", ".join(f"{c} long" for c in columns))


def circular_blocks(n: int, length: int, rng: np.random.Generator) -> np.ndarray:
    """Places of a circular block bootstrap."""
    starts = rng.integers(0, n, -(-n // length))
    return ((starts[:, None] + np.arange(length)) % n).ravel()[:n]


def block_shuffle(n: int, size: int, embargo: int, rng: np.random.Generator) -> np.ndarray:
    """Places with whole blocks dealt anew; the first rows of every block but the first are -1."""
    blocks = [np.arange(a, min(a + size, n)) for a in range(0, n, size)]
    out_ = []
    for k, b in enumerate(rng.permutation(len(blocks))):
        block = blocks[b].copy()
        if k:
            block[:embargo] = -1
        out_.append(block)
    return np.concatenate(out_)


def sequential_bootstrap(t0: np.ndarray, t1: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Events drawn one after the other, each with a chance in proportion to its uniqueness among those drawn."""
    n = int(t1.max()) + 1
    drawn, out_ = np.zeros(n), np.empty(draws, np.int64)
    starts, sizes = t0, t1 - t0
    for k in range(draws):
        share = np.concatenate([[0], np.cumsum(1 / (drawn + 1))])
        u = (share[t1] - share[starts]) / sizes
        out_[k] = rng.choice(len(t0), p=u / u.sum())
        drawn[t0[out_[k]] : t1[out_[k]]] += 1
    return out_


_replicates("circular_bootstrap", ["first", "distinct"], lambda rng: (int((x := circular_blocks(500, 20, rng))[0]), len(np.unique(x))))
_replicates("block_shuffles", ["first", "gone"], lambda rng: (int((x := block_shuffle(500, 25, 3, rng))[0]), int((x < 0).sum())))


@query("sequential_bootstrap")
def sequential_draws(spark, d):
    """As many draws as a series has events in its first 400 bars; series are drawn from side by side."""
    e = events(spark, d).where("t0 <= 400").select("sym", "t0", "t1")

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("t0")
        drawn = sequential_bootstrap(frame.t0.to_numpy(), frame.t1.to_numpy(), len(frame), np.random.default_rng(42))
        return pd.DataFrame({"sym": frame.sym.iloc[0], "draw": np.arange(len(drawn)), "t0": frame.t0.to_numpy()[drawn]})

    ship(spark)
    return e.groupBy("sym").applyInPandas(run, "sym string, draw long, t0 long")  # a bounded stretch of each series


# Signals


@query("rank_hold_signal", f"WITH {BARS_SQL}, k AS (SELECT sym, d, 2.0 * (row_number() OVER (PARTITION BY d ORDER BY r, sym) - 1) / nullif(count(*) OVER (PARTITION BY d) - 1, 0) - 1 AS x FROM rets WHERE r IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d) - 1 AS j FROM k) SELECT sym, d, round(last_value(CASE WHEN j % 5 = 0 THEN greatest(-0.8, least(0.8, x)) END IGNORE NULLS) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS x FROM n")
def rank_hold(spark, d):
    """Ranks of the cross-section, taken every fifth bar and held."""
    x = W.cross()
    k = rets(spark, d).where("r is not null").withColumn("x", 2.0 * (F.row_number().over(x.orderBy("r", "sym")) - 1) / F.nullif(F.count("*").over(x) - 1, F.lit(0)) - 1)
    k = k.withColumn("j", F.row_number().over(W.series()) - 1)
    taken = F.when(C("j") % 5 == 0, F.greatest(F.lit(-0.8), F.least(F.lit(0.8), C("x"))))
    return out(k, "sym", "d", x=F.last(taken, ignorenulls=True).over(W.expanding()))


@query("funding_carry_signal", f"WITH {BARS_SQL}, {FUNDING_SQL}, u AS (SELECT sym, d, sum(rate) * 1e4 AS x FROM funding GROUP BY ALL), j AS (SELECT b.sym, b.d, u.x, lr FROM rets b LEFT JOIN u USING (sym, d)), f AS (SELECT sym, d, lag(coalesce(x, 0)) OVER (PARTITION BY sym ORDER BY d) AS x, stddev_samp(lr) OVER f AS s, count(lr) OVER f AS n FROM j {w(20)}) SELECT sym, d, round(CASE WHEN n >= 20 AND abs(x / s) >= 0.1 THEN -tanh(3 * x / s) ELSE 0 END, 6) + 0.0 AS v FROM f")
def funding_carry(spark, d):
    """Against the carry in units of volatility, where it is large enough."""
    u = funding(spark, d).groupBy("sym", "d").agg((F.sum("rate") * 1e4).alias("x"))
    j = rets(spark, d).join(u, ["sym", "d"], "left").withColumn("x", F.lag(F.coalesce("x", F.lit(0.0))).over(W.series())).withColumn("s", W.rolling(C("lr"), "std", 20))
    ratio = F.try_divide(C("x"), C("s"))
    return out(j, "sym", "d", v=F.when(F.abs(ratio) >= 0.1, -F.tanh(3 * ratio)).otherwise(0.0))


@query("macro_overlay", f"WITH {BARS_SQL}, a AS (SELECT sym, d, i, c > avg(c) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS up, CASE WHEN count(lr) OVER f >= 30 THEN stddev_samp(lr) OVER f END AS v FROM rets {w(30)}), b AS (SELECT *, CASE WHEN count(v) OVER p >= 30 THEN v > quantile_cont(v, 0.5) OVER p END AS wild FROM a WINDOW p AS (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), m AS (SELECT sym, d, lag(CASE WHEN i >= 200 THEN up END) OVER o AS bull, lag(wild) OVER o AS wild FROM b WINDOW o AS (PARTITION BY sym ORDER BY d)) SELECT sym, d, CASE WHEN bull AND NOT wild THEN 1.0::DOUBLE WHEN bull THEN 0.7 WHEN NOT bull AND wild THEN 0.2 WHEN NOT bull THEN 0.5 ELSE 1.0 END AS m FROM m")
def macro_overlay(spark, d):
    """A multiplier for each state of trend and volatility."""
    return masks(spark, d).select("sym", "d", F.when(C("bull") & ~C("wild"), 1.0).when(C("bull"), 0.7).when(~C("bull") & C("wild"), 0.2).when(~C("bull"), 0.5).otherwise(1.0).alias("m"))


@query("combined_signal", f"WITH {BARS_SQL}, s AS (SELECT sym, d, tanh(10 * r) AS a, -tanh(10 * lag(r) OVER w) AS b, lead(r) OVER w AS y FROM rets WINDOW w AS (PARTITION BY sym ORDER BY d)), q AS (SELECT corr(a, y) AS ia, corr(b, y) AS ib FROM s WHERE d < DATE '1998-01-01') SELECT sym, d, round(greatest(-1, least(1, (abs(ia) * a * sign(ia) + abs(ib) * b * sign(ib)) / (abs(ia) + abs(ib)))), 6) + 0.0 AS v FROM s, q WHERE a IS NOT NULL AND b IS NOT NULL")
def combined_signal(spark, d):
    """Two signals by their correlation with what followed, fitted before 1998."""
    o = W.series()
    s = rets(spark, d).select("sym", "d", F.tanh(10 * C("r")).alias("a"), (-F.tanh(10 * F.lag("r").over(o))).alias("b"), F.lead("r").over(o).alias("y"))
    q = s.where("d < date'1998-01-01'").agg(F.corr("a", "y").alias("ia"), F.corr("b", "y").alias("ib"))
    x = s.where("a is not null and b is not null").crossJoin(F.broadcast(q))  # one row
    return out(x, "sym", "d", v=F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (C("ia") * C("a") + C("ib") * C("b")) / (F.abs("ia") + F.abs("ib")))))


@query("factor_alpha", f"WITH {BARS_SQL}, m AS (SELECT d, avg(r) AS m FROM rets WHERE r IS NOT NULL GROUP BY d) SELECT sym, round(regr_intercept(r, m) * 252, 5) AS alpha, round(regr_slope(r, m), 5) AS beta, round(regr_r2(r, m), 5) AS r2, count(r) AS n FROM rets JOIN m USING (d) GROUP BY sym")
def factor_alpha(spark, d):
    """What the market's mean return leaves unexplained."""
    r = rets(spark, d).where("r is not null")
    x = r.select("sym", "d", "r").join(r.groupBy("d").agg(F.avg("r").alias("m")), "d")
    return x.groupBy("sym").agg(F.round(F.regr_intercept("r", "m") * 252, 5).alias("alpha"), F.round(F.regr_slope("r", "m"), 5).alias("beta"), F.round(F.regr_r2("r", "m"), 5).alias("r2"), F.count("r").alias("n"))


@query("tsmom_score", f"WITH {BARS_SQL} SELECT sym, d, round((" + " + ".join(f"coalesce(sign(c / lag(c, {k}) OVER w - 1), 0)" for k in (10, 30, 90)) + ") / 3, 6) + 0.0 AS v FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)")
def tsmom_score(spark, d):
    o = W.series()
    return out(bars_1d(spark, d), "sym", "d", v=sum((F.coalesce(F.signum(F.try_divide(C("c"), F.lag("c", k).over(o)) - 1), F.lit(0.0)) for k in (10, 30, 90)), F.lit(0.0)) / 3)


@query("donchian_score", f"WITH {BARS_SQL}, x AS (SELECT sym, d, CASE WHEN c > max(h) OVER f THEN 1 WHEN c < min(l) OVER f THEN -1 END AS s FROM bars WINDOW f AS (PARTITION BY sym ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT sym, d, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v FROM x")
def donchian_score(spark, d):
    """The last breakout's side, until one on the other side."""
    f = W.series().rowsBetween(-20, -1)
    s = F.when(C("c") > F.max("h").over(f), 1).when(C("c") < F.min("l").over(f), -1)
    x = bars_1d(spark, d).withColumn("s", s)
    return x.select("sym", "d", F.coalesce(F.last("s", ignorenulls=True).over(W.expanding()), F.lit(0)).alias("v"))


@query("signal_harness", f"WITH {BARS_SQL}, s AS (SELECT sym, d, i, r AS x, lead(c, 5) OVER w / c - 1 AS y FROM rets WINDOW w AS (PARTITION BY sym ORDER BY d)) SELECT sym, count(y) AS n, round(corr(x, y), 5) AS ic, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0 END), 6) AS hits FROM s WHERE x IS NOT NULL AND y IS NOT NULL AND i % 5 = 0 GROUP BY sym")
def signal_harness(spark, d):
    """A signal every fifth bar against the return of the next five: the step is the harness's own."""
    s = rets(spark, d).select("sym", "i", C("r").alias("x"), (F.lead("c", 5).over(W.series()) / C("c") - 1).alias("y")).where("x is not null and y is not null and i % 5 = 0")
    return s.groupBy("sym").agg(F.count("y").alias("n"), F.round(F.corr("x", "y"), 5).alias("ic"), F.round(F.avg((F.signum("x") == F.signum("y")).cast("double")), 6).alias("hits"))


# Portfolios


def moments(spark, d) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Symbols, means and covariances of the days that all of them have: a matrix of the number of symbols squared."""
    b = rets(spark, d).where("r is not null")
    names = SYMBOLS
    a = b.groupBy("d").pivot("sym", names).agg(F.max("r")).dropna()
    row = a.agg(*(F.avg(x).alias(f"m{x}") for x in names), *(F.covar_samp(x, y).alias(f"{x}{y}") for x in names for y in names)).first()
    n = len(names)
    mean = np.array([row[f"m{x}"] or 0.0 for x in names])
    cov = np.array([row[f"{x}{y}"] if row[f"{x}{y}"] is not None else float(x == y) for x in names for y in names], float).reshape(n, n)
    return names, mean, cov


def capped(x: np.ndarray, cap: float) -> np.ndarray:
    """The nearest weights of 0 to cap that add up to one."""
    cap = max(cap, 1 / len(x))
    low, high = x.min() - cap - 1, x.max() + 1
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(x - mid, 0, cap).sum() > 1 else (low, mid)
    return np.clip(x - high, 0, cap)


def descended(grad, n: int, scale: float, cap: float, steps: int = 4000) -> np.ndarray:
    """Weights where a convex loss is least, by projected gradient; grad of the weights."""
    x = np.full(n, 1 / n)
    for _ in range(steps):
        x = capped(x - grad(x) / scale, cap)
    return x


def equal_risk(cov: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights whose parts of the risk are equal, by cyclic coordinates."""
    n = len(cov)
    x = 1 / np.sqrt(np.diag(cov))
    for _ in range(steps):
        for i in range(n):
            other = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-other + math.sqrt(other * other + 4 * cov[i, i] / n)) / (2 * cov[i, i])
    return x / x.sum()


def hierarchical(cov: np.ndarray) -> np.ndarray:
    """Risk parity over a tree of correlations: single linkage, then halves by their inverse-variance risk."""
    sd = np.sqrt(np.diag(cov))
    gap = np.sqrt(np.clip((1 - cov / np.outer(sd, sd)) / 2, 0, None))
    groups = [[i] for i in range(len(cov))]
    while len(groups) > 1:
        a, b = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: min(gap[x, y] for x in groups[p[0]] for y in groups[p[1]]))
        groups[b] = groups[b] + groups[a]
        del groups[a]
    order, weight = groups[0], np.ones(len(cov))

    def risk(part: list[int]) -> float:
        iv = 1 / np.diag(cov)[part]
        iv = iv / iv.sum()
        return float(iv @ cov[np.ix_(part, part)] @ iv)

    todo = [order]
    while todo:
        part = todo.pop()
        if len(part) > 1:
            left, right = part[: len(part) // 2], part[len(part) // 2 :]
            share = 1 - risk(left) / (risk(left) + risk(right))
            weight[left] *= share
            weight[right] *= 1 - share
            todo += [left, right]
    return weight


def posterior(mean: np.ndarray, cov: np.ndarray, picks: np.ndarray, views: np.ndarray, tau: float = 0.05) -> np.ndarray:
    """Means that blend the prior with views on combinations of assets, whose doubt is in proportion to their prior variance."""
    omega = np.diag(np.diag(picks @ (tau * cov) @ picks.T))
    gain = tau * cov @ picks.T @ np.linalg.inv(picks @ (tau * cov) @ picks.T + omega)
    return mean + gain @ (views - picks @ mean)


def shrunk(spark, d) -> tuple[list[str], np.ndarray, float]:
    """Covariance shrunk towards a scaled identity, and the share that the target gets; second and fourth moments from one pass."""
    names, mean, cov = moments(spark, d)
    a = rets(spark, d).where("r is not null").groupBy("d").pivot("sym", names).agg(F.max("r")).dropna()
    z = {x: C(x) - float(m) for x, m in zip(names, mean, strict=True)}
    square = sum((z[x] * z[x] for x in names), F.lit(0.0))
    row = a.agg(F.count("*").alias("n"), F.avg(square * square).alias("q")).first()
    n, p = row["n"], len(names)
    s = cov * (n - 1) / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, (row["q"] / p - (s**2).sum() / p) / n)
    share = b2 / d2 if d2 else 0.0
    return names, share * mu * np.eye(p) + (1 - share) * s, share


def _portfolio(name: str, weigh):
    @query(name)
    def run(spark, d):
        names, mean, cov = moments(spark, d)
        x = weigh(mean, cov)
        return spark.createDataFrame([(n, round(float(v), 5)) for n, v in zip(names, x, strict=True)], "sym string, w double")


VIEW, VIEWS = np.array([[1.0, -1.0, 0, 0, 0, 0]]), np.array([0.01])
_portfolio("equal_risk_contribution", lambda m, s: equal_risk(s))
_portfolio("minimum_variance_capped", lambda m, s: descended(lambda x: s @ x, len(m), np.trace(s), 0.3))
_portfolio("mean_variance", lambda m, s: descended(lambda x: 5 * s @ x - m, len(m), 5 * np.trace(s), 0.4))
_portfolio("black_litterman", lambda m, s: descended(lambda x: 5 * s @ x - posterior(m, s, VIEW, VIEWS), len(m), 5 * np.trace(s), 0.4))
_portfolio("hierarchical_risk_parity", lambda m, s: hierarchical(s))


@query("shrunk_covariance")
def shrunk_covariance(spark, d):
    names, cov, share = shrunk(spark, d)
    return spark.createDataFrame([(x, y, float(cov[i, j]), float(share)) for i, x in enumerate(names) for j, y in enumerate(names)], "x string, y string, cov double, share double")


METHODS = {"equal": lambda m, s: np.full(len(m), 1 / len(m)), "inverse_vol": lambda m, s: (1 / np.sqrt(np.diag(s))) / (1 / np.sqrt(np.diag(s))).sum(), "erc": lambda m, s: equal_risk(s), "hrp": lambda m, s: hierarchical(s), "min_variance": lambda m, s: descended(lambda x: s @ x, len(m), np.trace(s), 1.0)}


def optimize(spark, d, method: str) -> DataFrame:
    """Weights by the name of a method; raises for unknown ones."""
    if method not in METHODS:
        raise ValueError(f"no method {method}: {sorted(METHODS)}")
    names, mean, cov = moments(spark, d)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, METHODS[method](mean, cov), strict=True)], "sym string, w double")


@query("constrained_weights", f"WITH {WEIGHTS}, a AS (SELECT sym, d, least(greatest(w, 0), 0.35) AS x, coalesce(lag(w) OVER (PARTITION BY sym ORDER BY d), 0) AS old FROM w), b AS (SELECT sym, d, old, CASE WHEN x < 0.05 THEN 0 ELSE x END AS x FROM a), c AS (SELECT sym, d, old, x / nullif(sum(x) OVER (PARTITION BY d), 0) AS x FROM b), t AS (SELECT *, sum(abs(coalesce(x, 0) - old)) OVER (PARTITION BY d) AS turn FROM c) SELECT sym, d, round(old + (coalesce(x, 0) - old) * CASE WHEN turn > 0.5 THEN 0.5 / turn ELSE 1 END, 6) + 0.0 AS w FROM t")
def constrained_weights(spark, d):
    """Long-only, capped, without crumbs, renormalised, and no further from the old weights than the turnover allows."""
    x = W.cross()
    a = inverse_vol(spark, d).withColumn("old", F.coalesce(F.lag("w").over(W.series()), F.lit(0.0))).withColumn("x", F.least(F.greatest(C("w"), F.lit(0.0)), F.lit(0.35)))
    a = a.withColumn("x", F.when(C("x") < 0.05, 0.0).otherwise(C("x"))).withColumn("x", F.coalesce(F.try_divide(C("x"), F.sum("x").over(x)), F.lit(0.0)))
    turn = F.sum(F.abs(C("x") - C("old"))).over(x)
    return out(a, "sym", "d", w=C("old") + (C("x") - C("old")) * F.when(turn > 0.5, 0.5 / turn).otherwise(1.0))


@query("rebalance_decisions", f"WITH {WEIGHTS}, a AS (SELECT d, sum(abs(w - coalesce(lw, 0))) AS drift, sum((w - coalesce(lw, 0)) * coalesce(r, 0)) AS gain FROM (SELECT *, lag(w, 5) OVER (PARTITION BY sym ORDER BY d) AS lw FROM w) GROUP BY d) SELECT d, round(drift, 6) AS drift, drift > 0.1 AND abs(gain) > 0.0005 * drift AS go FROM a")
def rebalance_decisions(spark, d):
    """Whether weights have drifted enough, and whether what it gains is worth the cost."""
    a = inverse_vol(spark, d).withColumn("x", C("w") - F.coalesce(F.lag("w", 5).over(W.series()), F.lit(0.0)))
    g = a.groupBy("d").agg(F.sum(F.abs("x")).alias("drift"), F.sum(C("x") * F.coalesce("r", F.lit(0.0))).alias("gain"))
    return g.select("d", F.round("drift", 6).alias("drift"), ((C("drift") > 0.1) & (F.abs("gain") > 0.0005 * C("drift"))).alias("go"))


@query("breakeven_cost", f"WITH {BARS_SQL} SELECT sym, round(greatest(0, avg(r) / stddev_samp(r) * sqrt(252.0)) * stddev_samp(r) * sqrt(252.0) / 50 * 1e4, 4) AS bps FROM rets WHERE r IS NOT NULL GROUP BY sym")
def breakeven_cost(spark, d):
    """The cost at which a Sharpe ratio is used up by a yearly turnover of fifty."""
    r = rets(spark, d).where("r is not null").groupBy("sym")
    sd = F.stddev_samp("r")
    return r.agg(F.round(F.greatest(F.lit(0.0), F.try_divide(F.avg("r"), sd) * math.sqrt(252)) * sd * math.sqrt(252) / 50 * 1e4, 4).alias("bps"))


SCALED = f"{WEIGHTS}, b AS (SELECT d, sum(w * coalesce(r, 0)) AS x FROM (SELECT sym, d, r, lag(w) OVER (PARTITION BY sym ORDER BY d) AS w FROM w) GROUP BY d)"


@query("vol_scaled_book", f"WITH {SCALED} SELECT d, round(least(3, 0.15 / nullif(stddev_samp(x) OVER f * sqrt(365.0), 0)), 6) AS k FROM b WINDOW f AS (ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def vol_scaled_book(spark, d):
    """What brings the book's volatility of the last 60 days to the target, thrice at most. One row a day."""
    h = inverse_vol(spark, d).withColumn("h", F.lag("w").over(W.series()))
    b = h.groupBy("d").agg(F.sum(C("h") * F.coalesce("r", F.lit(0.0))).alias("x"))
    f = Window.orderBy("d").rowsBetween(-60, -1)
    return out(b, "d", k=F.least(F.lit(3.0), F.try_divide(F.lit(0.15), F.stddev_samp("x").over(f) * math.sqrt(365))))


@query("combined_sleeves", f"WITH {SIGNAL}, s AS (SELECT sym, d, (x + coalesce(lag(x, 5) OVER (PARTITION BY sym ORDER BY d), 0)) / 2 AS x FROM g) SELECT sym, d, round(x / greatest(1, sum(abs(x)) OVER (PARTITION BY d)), 6) + 0.0 AS w FROM s")
def combined_sleeves(spark, d):
    """The mean of two sleeves, then to a gross of one at most."""
    s = signal(spark, d).withColumn("x", (C("x") + F.coalesce(F.lag("x", 5).over(W.series()), F.lit(0.0))) / 2)
    return out(s, "sym", "d", w=C("x") / F.greatest(F.lit(1.0), F.sum(F.abs("x")).over(W.cross())))


# Risk


RISK = f"""{SIGNAL}, r1 AS (SELECT sym, d, k, greatest(-0.5, least(0.5, x)) AS a, x FROM g), r2 AS (SELECT *, a * CASE WHEN sum(abs(a)) OVER (PARTITION BY d, k) > 0.8 THEN 0.8 / sum(abs(a)) OVER (PARTITION BY d, k) ELSE 1 END AS b FROM r1),
 r3 AS (SELECT *, b * CASE WHEN sum(abs(b)) OVER (PARTITION BY d) > 1.2 THEN 1.2 / sum(abs(b)) OVER (PARTITION BY d) ELSE 1 END AS c FROM r2)"""


def limited(spark, d) -> DataFrame:
    """Limits in their fixed order: each asset, each cluster, gross; every step keeps those before it."""
    g = signal(spark, d).withColumn("a", F.greatest(F.lit(-0.5), F.least(F.lit(0.5), C("x"))))
    cluster, gross = (F.sum(F.abs(c)).over(Window.partitionBy(*by)) for c, by in (("a", ("d", "k")), ("b", ("d",))))
    g = g.withColumn("b", C("a") * F.when(cluster > 0.8, 0.8 / cluster).otherwise(1.0))
    return g.withColumn("c", C("b") * F.when(gross > 1.2, 1.2 / gross).otherwise(1.0))


@query("risk_decisions", f"WITH {RISK} SELECT sym, d, round(c, 6) + 0.0 AS w FROM r3")
def risk_decisions(spark, d):
    return out(limited(spark, d), "sym", "d", w=C("c"))


@query("binding_limits", f"WITH {RISK}, t AS (SELECT 'asset' AS kind, abs(x) - abs(a) AS cut FROM r3 UNION ALL SELECT 'cluster', abs(a) - abs(b) FROM r3 UNION ALL SELECT 'gross', abs(b) - abs(c) FROM r3) SELECT kind, count_if(cut > 1e-9) AS n, round(sum(cut), 4) AS total FROM t GROUP BY kind")
def binding_limits(spark, d):
    """How often each limit bound, and how much it took."""
    g = limited(spark, d)
    cut = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), (F.abs(x) - F.abs(y)).alias("cut"))
    t = g.select(F.inline(F.array(cut("asset", "x", "a"), cut("cluster", "a", "b"), cut("gross", "b", "c"))))
    return t.groupBy("kind").agg(F.count_if(C("cut") > 1e-9).alias("n"), F.round(F.sum("cut"), 4).alias("total"))


def governor_step(soft: float, hard: float):
    """Losses of a day: a soft stop while it lasts, a hard one until the day ends: (time, state)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, day, equity = row
        if day != s["day"]:
            s.update(day=day, open=equity, hard=False)
        loss = 1 - equity / s["open"]
        s["hard"] = s["hard"] or loss >= hard
        return [(at, "flatten" if s["hard"] else "soft" if loss >= soft else "ok")]

    return lambda: {"day": None, "open": 0.0, "hard": False}, step


@query("daily_governor", "WITH t AS (SELECT event_type AS sym, ts, event_id, CAST(ts AS DATE) AS day, 1000 + value AS e FROM events), o AS (SELECT *, first_value(e) OVER w AS open, 1 - e / first_value(e) OVER w AS loss FROM t WINDOW w AS (PARTITION BY sym, day ORDER BY ts, event_id)), h AS (SELECT *, max(loss) OVER (PARTITION BY sym, day ORDER BY ts, event_id) AS worst FROM o) SELECT sym, event_id AS at, CASE WHEN worst >= 0.05 THEN 'flatten' WHEN loss >= 0.02 THEN 'soft' ELSE 'ok' END AS state FROM h")
def daily_governor(spark, d):
    t = ticks(spark, d).select("sym", "ts", "seq", F.to_date("ts").cast("string").alias("day"), (1000 + C("price")).alias("e"))
    return S.fold(t, "sym", ["ts", "seq"], ["seq", "day", "e"], *governor_step(0.02, 0.05), "sym string, at long, state string", ["sym", "at", "state"], [pa.string(), pa.int64(), pa.string()])


@query("gap_kelly", f"WITH {BARS_SQL} SELECT sym, round(greatest(0, least(0.5, avg(r) / (var_samp(r) + max(abs(r)) ** 2 / 100) / 4)), 6) + 0.0 AS f FROM rets WHERE r IS NOT NULL GROUP BY sym")
def gap_kelly(spark, d):
    """A quarter of Kelly, with the largest jump added to the variance."""
    r = rets(spark, d).where("r is not null").groupBy("sym")
    return r.agg((F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.5), F.avg("r") / (F.var_samp("r") + F.max(F.abs("r")) ** 2 / 100) / 4)), 6) + 0.0).alias("f"))


@query("binary_kelly", "SELECT event_type, round(greatest(0, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END) - (1 - avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END)) - 0.02), 6) AS f FROM events GROUP BY event_type")
def binary_kelly(spark, d):
    """Of an even bet with a cost."""
    p = F.avg((C("value") > 50).cast("double"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.greatest(F.lit(0.0), p - (1 - p) - 0.02), 6).alias("f"))


@query("stress_windows", f"WITH {BARS_SQL}, s AS (SELECT * FROM (VALUES ('a', DATE '1996-03-01', DATE '1996-04-15'), ('b', DATE '1998-08-01', DATE '1998-10-31')) v(name, lo, hi)), x AS (SELECT name, sym, d, sum(lr) OVER (PARTITION BY name, sym ORDER BY d) AS l FROM rets JOIN s ON d BETWEEN lo AND hi WHERE lr IS NOT NULL), y AS (SELECT *, max(l) OVER (PARTITION BY name, sym ORDER BY d) AS m FROM x) SELECT name, sym, round(max_by(l, d), 5) AS total, round(min(exp(l - m)) - 1, 5) AS worst FROM y GROUP BY name, sym")
def stress_windows(spark, d):
    """Growth and the deepest fall in fixed windows of the past."""
    s = spark.createDataFrame([("a", "1996-03-01", "1996-04-15"), ("b", "1998-08-01", "1998-10-31")], "name string, lo string, hi string").select("name", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    o = Window.partitionBy("name", "sym").orderBy("d")
    x = rets(spark, d).where("lr is not null").join(F.broadcast(s), C("d").between(C("lo"), C("hi"))).withColumn("l", F.sum("lr").over(o))  # two rows
    x = x.withColumn("m", F.max("l").over(o))
    return x.groupBy("name", "sym").agg(F.round(F.max_by("l", "d"), 5).alias("total"), F.round(F.min(F.exp(C("l") - C("m"))) - 1, 5).alias("worst"))


@query("beta_hedge", f"WITH {BARS_SQL}, m AS (SELECT d, r AS m FROM rets WHERE sym = 'NO'), b AS (SELECT sym, regr_slope(r, m) AS beta FROM rets JOIN m USING (d) WHERE r IS NOT NULL GROUP BY sym) SELECT round(sum(beta), 5) AS beta, round(CASE WHEN abs(sum(beta)) > 0.1 THEN -(sum(beta) - sign(sum(beta)) * 0.1) ELSE 0 END, 5) AS hedge FROM b WHERE sym <> 'NO'")
def beta_hedge(spark, d):
    """The position in one series that brings the others' beta back into its band."""
    r = rets(spark, d).where("r is not null").select("sym", "d", "r")
    m = r.where("sym = 'NO'").select("d", C("r").alias("m"))
    b = r.where("sym <> 'NO'").join(m, "d").groupBy("sym").agg(F.regr_slope("r", "m").alias("b")).agg(F.sum("b").alias("b"))
    return b.select(F.round("b", 5).alias("beta"), F.round(F.when(F.abs("b") > 0.1, -(C("b") - F.signum("b") * 0.1)).otherwise(0.0), 5).alias("hedge"))


@query("drawdown_probability")
def drawdown_probability(spark, d):
    """Of 400 paths of a hundred trades in blocks, the share that falls by a fifth at one hundredth of risk a trade; a path for each seed."""
    e = events(spark, d).where("t0 <= 400").agg(F.sort_array(F.collect_list(F.struct("t0", "sym", "r"))).alias("x")).first()["x"]  # of six series, 400 bars each at most
    r = np.array([v["r"] for v in e], float)
    if not len(r):
        return spark.createDataFrame([], "p double")
    r = r / (r.std() or 1.0)
    ship(spark)

    def run(batches):
        for batch in batches:
            ids, hits = batch.column("id").to_pylist(), []
            for i in ids:
                path = np.cumprod(1 + 0.01 * r[circular_blocks(len(r), 5, np.random.default_rng([5, i]))[:100]])
                hits.append(float((path / np.maximum.accumulate(np.append(1.0, path))[1:]).min() <= 0.8))
            yield pa.record_batch([pa.array(hits)], ["hit"])

    return spark.range(400).mapInArrow(run, "hit double").agg(F.avg("hit").alias("p"))


# Execution


@query("funding_cost", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 0.0001 * (l_quantity / 8), 9) AS cost FROM lineitem")
def funding_cost(spark, d):
    """Of a notional held for as many hours as the line has units."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C("l_extendedprice") * 0.0001 * (C("l_quantity") / 8), 9).alias("cost"))


@query("max_size_for_alpha", f"WITH {BARS_SQL} SELECT sym, d, round(least(0.1, (0.002 * 0.5 / (0.8 * s)) ** 2) * notional, 4) AS size FROM (SELECT sym, d, notional, stddev_samp(lr) OVER f AS s, count(lr) OVER f AS n FROM rets {w(20)}) WHERE n >= 20 AND s > 0")
def max_size_for_alpha(spark, d):
    """The notional whose impact eats half of the expected gain, a tenth of the volume at most."""
    x = rets(spark, d).withColumn("s", W.rolling(C("lr"), "std", 20)).where("s > 0")
    return out(x, "sym", "d", digits=4, size=F.least(F.lit(0.1), (0.002 * 0.5 / (0.8 * C("s"))) ** 2) * C("notional"))


def latch_step(on: float, off: float):
    """A state that goes on at or below one level and off at or above another: (time, on)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, x = row
        if x is not None:
            s["on"] = x <= on or (s["on"] and x < off)
        return [(at, s["on"])]

    return lambda: {"on": False}, step


@query("skew_latch")
def skew_latch(spark, d):
    """Costs count double from a panic in the rolling skew until it has calmed."""
    b = rets(spark, d).withColumn("k", W.rolling(C("lr"), "skew", 60)).select("sym", C("i").cast("long").alias("i"), "k")
    k = S.fold(b, "sym", ["i"], ["i", "k"], *latch_step(-0.5, 0.0), "sym string, at long, panic boolean", ["sym", "at", "panic"], [pa.string(), pa.int64(), pa.bool_()])
    return k.select("sym", "at", "panic", F.when(C("panic"), 2.0).otherwise(1.0).alias("multiplier"))


SPREAD = f"{BARS_SQL}, sp AS (SELECT sym, d, least(0.02, greatest(0.0005, 0.0011 + 0.1 * stddev_samp(lr) OVER f * sqrt(1000 / nullif(avg(notional) OVER f, 0)))) AS s, count(lr) OVER f AS n FROM rets {w(20)})"


def spreads(spark, d) -> DataFrame:
    """Fees and a part of the volatility by the square root of a reference trade over the depth, within bounds."""
    f = W.trailing(20)
    s = F.stddev_samp("lr").over(f) * F.sqrt(F.try_divide(F.lit(1000.0), F.avg("notional").over(f)))
    return rets(spark, d).withColumn("s", F.least(F.lit(0.02), F.greatest(F.lit(0.0005), 0.0011 + 0.1 * s))).withColumn("n", F.count("lr").over(f))


@query("dynamic_spread", f"WITH {SPREAD} SELECT sym, d, round(CASE WHEN n >= 20 THEN s END, 6) AS s FROM sp")
def dynamic_spread(spark, d):
    return out(spreads(spark, d), "sym", "d", s=F.when(C("n") >= 20, C("s")))


@query("detected_spread", f"WITH {SPREAD} SELECT sym, round(quantile_cont(s, 0.5), 6) AS s FROM sp WHERE n >= 20 GROUP BY sym")
def detected_spread(spark, d):
    return spreads(spark, d).where("n >= 20").groupBy("sym").agg(F.round(F.percentile("s", 0.5), 6).alias("s"))


@query("impact_bound", f"WITH {BARS_SQL}, v AS (SELECT sym, (h - l) / c AS x, stddev_samp(lr) OVER f AS s, count(lr) OVER f AS n FROM rets {w(20)}) SELECT sym, round(quantile_cont(x / s, 0.5), 5) AS eta FROM v WHERE n >= 20 AND s > 0 GROUP BY sym")
def impact_bound(spark, d):
    """The range of a bar over its volatility: impact can't be more."""
    x = rets(spark, d).withColumn("s", W.rolling(C("lr"), "std", 20)).where("s > 0")
    return x.groupBy("sym").agg(F.round(F.percentile((C("h") - C("l")) / C("c") / C("s"), 0.5), 5).alias("eta"))


ORDERS = f"{WEIGHTS}, o AS (SELECT sym, d, c, w * 1e6 / c AS q FROM (SELECT w.sym, w.d, w.w, bars.c FROM w JOIN bars USING (sym, d))), t AS (SELECT sym, d, c, q - coalesce(lag(q) OVER (PARTITION BY sym ORDER BY d), 0) AS dq FROM o)"


def orders(spark, d) -> DataFrame:
    """Changes of quantity that weights ask for."""
    q = inverse_vol(spark, d).withColumn("q", C("w") * 1e6 / C("c"))
    return q.withColumn("dq", C("q") - F.coalesce(F.lag("q").over(W.series()), F.lit(0.0)))


@query("built_orders", f"WITH {ORDERS} SELECT sym, d, round(dq, 5) AS qty, CASE WHEN dq > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM t WHERE abs(dq * c) >= 5000")
def built_orders(spark, d):
    """Orders above the least notional."""
    return orders(spark, d).where(F.abs(C("dq") * C("c")) >= 5000).select("sym", "d", F.round("dq", 5).alias("qty"), F.when(C("dq") > 0, "BUY").otherwise("SELL").alias("side"))


@query("executed_orders", f"WITH {ORDERS}, x AS (SELECT t.sym, t.d, t.c, dq, notional, least(abs(dq * t.c), 0.1 * notional) AS done FROM t JOIN bars USING (sym, d)) SELECT sym, d, round(done, 4) AS filled, round(done * (0.0005 + 0.00055 + 0.8 * 0.02 * sqrt(done / nullif(notional, 0))), 4) AS cost, CASE WHEN done < abs(dq * c) - 1e-6 THEN 'partial' ELSE 'full' END AS result FROM x WHERE abs(dq * c) >= 5000")
def executed_orders(spark, d):
    """Fills of a tenth of the bar's volume at most, with half spread, fee and impact."""
    wanted = F.abs(C("dq") * C("c"))
    x = orders(spark, d).where(wanted >= 5000).withColumn("done", F.least(wanted, 0.1 * C("notional")))
    cost = C("done") * (0.0005 + 0.00055 + 0.8 * 0.02 * F.sqrt(F.try_divide(C("done"), C("notional"))))
    return x.select("sym", "d", F.round("done", 4).alias("filled"), F.round(cost, 4).alias("cost"), F.when(C("done") < wanted - 1e-6, "partial").otherwise("full").alias("result"))


@query("queue_fills", f"WITH {BARS_SQL}, j AS (SELECT a.sym, a.d, b.i - a.i AS k, CASE WHEN b.l <= a.c * 0.98 THEN b.vol * 0.2 ELSE 0 END AS v FROM rets a JOIN rets b ON a.sym = b.sym AND b.i > a.i AND b.i <= a.i + 6), c AS (SELECT sym, d, k, sum(v) OVER (PARTITION BY sym, d ORDER BY k) AS v FROM j) SELECT sym, d, min(CASE WHEN v >= 10 THEN k END)::INT AS wait FROM c GROUP BY sym, d")
def queue_fills(spark, d):
    """Bars until a limit order two per cent lower has seen its queue pass, six at most: a fifth of the volume of the bars that touch it counts."""
    ahead = W.series().rowsBetween(1, 6)
    b = bars_1d(spark, d).withColumn("path", F.collect_list(F.struct("l", "vol")).over(ahead)).where(F.size("path") > 0)
    passed = F.transform("path", lambda p: F.when(p["l"] <= C("c") * 0.98, p["vol"] * 0.2).otherwise(0.0))
    upto = F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.aggregate(F.slice(passed, F.lit(1), k), F.lit(0.0), lambda t, v: t + v))
    at = F.array_position(F.transform(upto, lambda v: v >= 10), True)
    return b.select("sym", "d", F.when(at > 0, at).cast("int").alias("wait"))


@query("pre_trade_cost", "SELECT l_orderkey, l_linenumber, round((0.0005 + 0.8 * 0.02 * sqrt(l_extendedprice / 5e6)) * 1e4, 5) AS bps FROM lineitem")
def pre_trade_cost(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round((0.0005 + 0.8 * 0.02 * F.sqrt(C("l_extendedprice") / 5e6)) * 1e4, 5).alias("bps"))


@query("label_costs", f"WITH {EVENTS_SQL}, {FUNDING_SQL}, u AS (SELECT sym, d, sum(rate) AS x FROM funding GROUP BY ALL), c AS (SELECT r.sym, r.i, sum(coalesce(u.x, 0)) OVER (PARTITION BY r.sym ORDER BY r.i) AS s FROM rets r LEFT JOIN u USING (sym, d)), n AS (SELECT sym, max(i) AS n FROM rets GROUP BY sym) SELECT ev.sym, ev.t0, round((0.0021 + b.s - a.s) * 1e4, 8) AS bps FROM ev JOIN n USING (sym) JOIN c a ON a.sym = ev.sym AND a.i = ev.t0 JOIN c b ON b.sym = ev.sym AND b.i = least(ev.t1, n.n)")
def label_costs(spark, d):
    """A round trip and the funding between entry and exit, from running sums."""
    u = funding(spark, d).groupBy("sym", "d").agg(F.sum("rate").alias("x"))
    c = rets(spark, d).join(u, ["sym", "d"], "left").select("sym", C("i").cast("long").alias("i"), F.sum(F.coalesce("x", F.lit(0.0))).over(W.expanding()).alias("s"))
    n = c.groupBy("sym").agg(F.max("i").alias("n"))
    e = events(spark, d).join(F.broadcast(n), "sym").withColumn("t1", F.least("t1", "n"))  # a row for each symbol
    e = e.join(c.select("sym", C("i").alias("t0"), C("s").alias("a")), ["sym", "t0"]).join(c.select("sym", C("i").alias("t1"), C("s").alias("b")), ["sym", "t1"])
    return e.select("sym", "t0", F.round((0.0021 + C("b") - C("a")) * 1e4, 8).alias("bps"))


@query("execution_analysis", f"WITH {TCA}, x AS (SELECT sym, bps, 5 + 0.1 * abs(bps) AS expected FROM s) SELECT sym, count(*) AS n, round(avg(bps - expected), 4) AS excess, round(avg(CASE WHEN bps > expected THEN 1.0 ELSE 0 END), 6) AS above FROM x GROUP BY sym")
def execution_analysis(spark, d):
    """What trades cost beyond what was expected of them."""
    x = shortfall(spark, d).withColumn("e", 5 + 0.1 * F.abs("bps"))
    return x.groupBy("sym").agg(F.count("*").alias("n"), F.round(F.avg(C("bps") - C("e")), 4).alias("excess"), F.round(F.avg((C("bps") > C("e")).cast("double")), 6).alias("above"))


@query("cost_closure", f"WITH {ORDERS}, x AS (SELECT sym, abs(dq * c) AS v FROM t) SELECT sym, round(sum(v * 0.0005), 3) AS spread, round(sum(v * 0.00055), 3) AS fee, round(sum(v * 0.00105), 3) AS total, abs(sum(v * 0.0005) + sum(v * 0.00055) - sum(v * 0.00105)) < 1e-6 * sum(v) AS closes FROM x GROUP BY sym")
def cost_closure(spark, d):
    """Whether the parts of the cost add up to it."""
    v = F.abs(C("dq") * C("c"))
    g = orders(spark, d).select("sym", v.alias("v")).groupBy("sym").agg(F.sum(C("v") * 0.0005).alias("a"), F.sum(C("v") * 0.00055).alias("b"), F.sum(C("v") * 0.00105).alias("t"), F.sum("v").alias("v"))
    return g.select("sym", F.round("a", 3).alias("spread"), F.round("b", 3).alias("fee"), F.round("t", 3).alias("total"), (F.abs(C("a") + C("b") - C("t")) < 1e-6 * C("v")).alias("closes"))
