"""Data quality, joins over time, calendars, stores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import timeline as T
from tidemark.plans.features import rets
from tidemark.plans.registry import out, query
from tidemark.sources.tables import BARS_SQL, FUNDING_SQL, SYMBOLS, TICKS_SQL, bars_1d, funding, table, ticks

C = F.col


@query("gap_detect", f"WITH {BARS_SQL}, g AS (SELECT sym, lag(d) OVER (PARTITION BY sym ORDER BY d) AS gap_start, d AS gap_end FROM bars) SELECT sym, gap_start, gap_end, CAST(gap_end - gap_start - 1 AS INT) AS n_missing FROM g WHERE gap_end - gap_start > 1")
def gap_detect(spark, d):
    return T.gaps(bars_1d(spark, d), "sym", "d")


@query("gap_summary", f"WITH {BARS_SQL}, g AS (SELECT sym, d - lag(d) OVER (PARTITION BY sym ORDER BY d) - 1 AS n FROM bars) SELECT sym, count(*) AS gaps, sum(n)::BIGINT AS missing, max(n)::BIGINT AS longest FROM g WHERE n > 0 GROUP BY sym")
def gap_summary(spark, d):
    return T.gaps(bars_1d(spark, d), "sym", "d").groupBy("sym").agg(F.count("*").alias("gaps"), F.sum("n_missing").alias("missing"), F.max("n_missing").cast("long").alias("longest"))


@query("outlier_report", f"WITH {BARS_SQL} SELECT sym, count_if(abs(lr) > 0.5) AS jumps, count_if(vol = 0) AS no_volume, count_if(h < l) AS crossed, round(max(abs(lr)), 6) AS worst FROM rets GROUP BY sym")
def outliers(spark, d):
    return rets(spark, d).groupBy("sym").agg(F.count_if(F.abs("lr") > 0.5).alias("jumps"), F.count_if(C("vol") == 0).alias("no_volume"), F.count_if(C("h") < C("l")).alias("crossed"), F.round(F.max(F.abs("lr")), 6).alias("worst"))


@query("outlier_top", f"WITH {BARS_SQL} SELECT sym, d, round(lr, 6) AS lr FROM rets WHERE lr IS NOT NULL ORDER BY abs(lr) DESC, sym, d LIMIT 20")
def outlier_top(spark, d):
    return rets(spark, d).where("lr is not null").orderBy(F.abs("lr").desc(), "sym", "d").limit(20).select("sym", "d", F.round("lr", 6).alias("lr"))


@query(
    "schema_contract_counts",
    f"""WITH {TICKS_SQL}, t AS (SELECT *, lag(ts) OVER (PARTITION BY sym ORDER BY ts, seq) AS p FROM ticks)
    SELECT count(*) AS n, count_if(sym IS NULL) AS no_sym, count_if(ts IS NULL) AS no_ts, count_if(price IS NULL OR price <= 0) AS bad_price, count_if(qty <= 0) AS bad_qty, count_if(p = ts) AS same_ts, count_if(side NOT IN ('buy', 'sell')) AS bad_side FROM t""",
)
def contract_counts(spark, d):
    """All checks in one pass."""
    t = ticks(spark, d).withColumn("p", F.lag("ts").over(Window.partitionBy("sym").orderBy("ts", "seq")))
    checks = {"no_sym": C("sym").isNull(), "no_ts": C("ts").isNull(), "bad_price": C("price").isNull() | (C("price") <= 0), "bad_qty": C("qty") <= 0, "same_ts": C("p") == C("ts"), "bad_side": ~C("side").isin("buy", "sell")}
    return t.agg(F.count("*").alias("n"), *(F.count_if(x).alias(k) for k, x in checks.items()))


@query("feature_health", f"WITH {BARS_SQL}, u AS (SELECT 'lr' AS feature, lr AS x FROM rets UNION ALL SELECT 'r', r FROM rets UNION ALL SELECT 'notional', notional FROM rets) SELECT feature, count(*) AS n, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0 END), 6) AS null_rate, coalesce(var_samp(x) > 0, false) AS varies FROM u GROUP BY feature")
def feature_health(spark, d):
    u = rets(spark, d).select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), C(c).alias("x")) for c in ("lr", "r", "notional")))).alias("u")).select("u.*")
    return u.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg(C("x").isNull().cast("double")), 6).alias("null_rate"), F.coalesce(F.var_samp("x") > 0, F.lit(False)).alias("varies"))


@query(
    "asof_funding_tol",
    f"""WITH {BARS_SQL}, {FUNDING_SQL}, u AS (SELECT sym, d, max_by(rate, seq) AS rate FROM funding GROUP BY sym, d)
    SELECT b.sym, b.d, round(CASE WHEN b.d - u.d <= 2 THEN u.rate END * 1e6, 7) AS rate FROM bars b ASOF LEFT JOIN u ON b.sym = u.sym AND b.d >= u.d""",
)
def asof_funding(spark, d):
    """The last known rate, at most two days old."""
    joined = T.asof_join(bars_1d(spark, d).select("sym", "d"), funding(spark, d), "d", ["sym"], ["rate"], F.expr("interval 2 days"), order="seq")
    return joined.select("sym", "d", F.round(C("rate") * 1e6, 7).alias("rate"))


@query(
    "asof_lagged",
    f"""WITH {BARS_SQL}, {FUNDING_SQL}, u AS (SELECT sym, d + 1 AS d, max_by(rate, seq) AS rate FROM funding GROUP BY sym, d)
    SELECT b.sym, b.d, round(CASE WHEN b.d - u.d <= 5 THEN u.rate END * 1e6, 7) AS rate FROM bars b ASOF LEFT JOIN u ON b.sym = u.sym AND b.d >= u.d""",
)
def asof_lagged(spark, d):
    """Published a day later."""
    late = funding(spark, d).withColumn("d", F.date_add("d", 1))
    joined = T.asof_join(bars_1d(spark, d).select("sym", "d"), late, "d", ["sym"], ["rate"], F.expr("interval 5 days"), order="seq")
    return joined.select("sym", "d", F.round(C("rate") * 1e6, 7).alias("rate"))


@query(
    "asof_ticks_multi_clock",
    f"""WITH {TICKS_SQL}, l AS (SELECT seq, ts FROM ticks WHERE sym = 'purchase'), k AS (SELECT ts, price FROM ticks WHERE sym = 'click'), v AS (SELECT ts, price FROM ticks WHERE sym = 'view')
    SELECT l.seq, round(CASE WHEN l.ts - k.ts <= INTERVAL 30 MINUTE THEN k.price END, 6) AS click, round(CASE WHEN l.ts - v.ts <= INTERVAL 2 HOUR THEN v.price END, 6) AS view FROM l ASOF LEFT JOIN k ON l.ts >= k.ts ASOF LEFT JOIN v ON l.ts >= v.ts""",
)
def asof_multi(spark, d):
    """Two clocks, each with its own tolerance. One series only, so the hour is the key and each hour carries in the last row before it."""
    t = ticks(spark, d)
    one = lambda sym, name: t.where(C("sym") == sym).select(F.lit(1).alias("k"), "ts", "seq", C("price").alias(name))
    left = t.where("sym = 'purchase'").select(F.lit(1).alias("k"), "ts", "seq")
    a = T.asof_join(left, one("click", "click"), "ts", ["k"], ["click"], F.expr("interval 30 minutes"), order="seq")
    b = T.asof_join(a, one("view", "view"), "ts", ["k"], ["view"], F.expr("interval 2 hours"), order="seq")
    return out(b, "seq", click=C("click"), view=C("view"))


@query(
    "funding_settlement_sums",
    f"WITH {BARS_SQL}, {FUNDING_SQL}, f AS (SELECT sym, d + 1 AS d, sum(rate) AS x FROM funding GROUP BY sym, d) SELECT b.sym, b.d, round(coalesce(x, 0) * 1e6, 7) AS settled FROM bars b LEFT JOIN f ON f.sym = b.sym AND f.d = b.d",
)
def settlement(spark, d):
    s = T.interval_sums(funding(spark, d), bars_1d(spark, d).select("sym", "d"), "rate", "sym", "d", "d")
    return s.select("sym", "d", F.round(C("settled") * 1e6, 7).alias("settled"))


@query(
    "spine_fill_forward",
    f"""WITH {BARS_SQL}, s AS (SELECT sym, unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM bars GROUP BY sym)
    SELECT s.sym, s.d, round(last_value(c IGNORE NULLS) OVER (PARTITION BY s.sym ORDER BY s.d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 8) AS c FROM s LEFT JOIN bars b ON b.sym = s.sym AND b.d = s.d""",
)
def spine(spark, d):
    b = bars_1d(spark, d)
    s = T.spine(b, "sym", "d").join(b.select("sym", "d", "c"), ["sym", "d"], "left")
    return out(T.fill_forward(s, ["c"], "sym", "d", 3), "sym", "d", digits=8, c=C("c"))


@query(
    "membership_calendar",
    """WITH e AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS member, CAST(o_orderdate AS DATE) AS d, max_by(CASE WHEN o_orderkey % 3 = 0 THEN 'remove' ELSE 'add' END, o_orderkey) AS action FROM orders GROUP BY 1, 2),
    days AS (SELECT member, m::DATE AS d FROM (SELECT DISTINCT member FROM e), (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01', INTERVAL 1 MONTH)) AS m))
    SELECT days.member, days.d FROM days ASOF JOIN e ON days.member = e.member AND days.d >= e.d WHERE e.action = 'add'""",
)
def membership(spark, d):
    e = table(spark, d, "orders").select((C("o_custkey") % 50).alias("member"), F.to_date("o_orderdate").alias("d"), F.when(C("o_orderkey") % 3 == 0, "remove").otherwise("add").alias("action"), "o_orderkey")
    e = e.groupBy("member", "d").agg(F.max_by("action", "o_orderkey").alias("action"))
    months = F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("1998-01-01").cast("date"), F.expr("interval 1 month")))
    days = e.select("member").distinct().select("member", months.alias("d"))
    return T.asof_join(days, e, "d", ["member"], ["action"], F.expr("interval 10000 days")).where("action = 'add'").select("member", "d")


@query("close_panel_pivot", f"WITH {BARS_SQL} SELECT d, " + ", ".join(f"round(max(CASE WHEN sym = '{s}' THEN c END), 8) AS {s.lower()}" for s in SYMBOLS) + " FROM bars GROUP BY d")
def close_panel(spark, d):
    p = bars_1d(spark, d).groupBy("d").pivot("sym", SYMBOLS).agg(F.max("c"))
    return p.select("d", *(F.round(s, 8).alias(s.lower()) for s in SYMBOLS))


@query("dedup_keep_last", "SELECT user_id, event_type, max(event_id) AS event_id, round(max_by(value, (ts, event_id)), 6) AS value FROM events GROUP BY user_id, event_type".replace("max(event_id) AS event_id", "max_by(event_id, (ts, event_id)) AS event_id"))
def dedup(spark, d):
    e = table(spark, d, "events")
    return T.keep_last(e.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], [C("ts"), C("event_id")]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("feature_store_upsert", "SELECT user_id, event_type, CAST(ts AS DATE) AS d, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS versions FROM events GROUP BY ALL")
def upsert(spark, d):
    e = table(spark, d, "events").withColumn("d", F.to_date("ts"))
    return e.groupBy("user_id", "event_type", "d").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("versions"))


@query("latest_timestamp", f"WITH {TICKS_SQL} SELECT sym, max(ts) AS ts FROM ticks GROUP BY sym")
def latest(spark, d):
    return ticks(spark, d).groupBy("sym").agg(F.max("ts").alias("ts"))


@query("range_scan", f"WITH {BARS_SQL} SELECT sym, d, round(c, 8) AS c FROM bars WHERE d >= DATE '1997-01-01' AND d < DATE '1998-01-01' AND sym IN ('NO', 'RF')")
def range_scan(spark, d):
    return bars_1d(spark, d).where("d >= date'1997-01-01' and d < date'1998-01-01' and sym in ('NO', 'RF')").select("sym", "d", F.round("c", 8).alias("c"))


@query("content_digest", "SELECT count(*) AS n, bit_xor(('0x' || md5(CAST(c_custkey AS VARCHAR) || '|' || c_name)[1:15])::BIGINT) AS digest FROM customer")
def digest(spark, d):
    """Independent of the rows' order."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", C("c_custkey").cast("string"), "c_name")), 1, 15), 16, 10).cast("long")
    return table(spark, d, "customer").agg(F.count("*").alias("n"), F.bit_xor(h).alias("digest"))


@query("json_props", "SELECT event_type, CAST(props ->> 'k' AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("array_top_levels", "SELECT vec_id, round(list_sum(list_sort(embedding::DOUBLE[], 'DESC')[1:5]), 5) AS top5, round(list_max(embedding::DOUBLE[]), 5) AS best, len(embedding) AS n FROM embeddings")
def array_top(spark, d):
    a = C("embedding").cast("array<double>")
    top = F.aggregate(F.slice(F.sort_array(a, asc=False), 1, 5), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(top, 5).alias("top5"), F.round(F.array_max(a), 5).alias("best"), F.size("embedding").cast("long").alias("n"))


@query("rollup_month", f"WITH {BARS_SQL} SELECT sym, date_trunc('month', d)::DATE AS m, round(sum(notional), 2) AS notional, sum(n)::BIGINT AS n FROM bars GROUP BY ROLLUP (sym, m)")
def rollup_month(spark, d):
    return bars_1d(spark, d).withColumn("m", F.trunc("d", "month")).rollup("sym", "m").agg(F.round(F.sum("notional"), 2).alias("notional"), F.sum("n").alias("n"))


@query("cube_flags", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
    SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM k GROUP BY user_id, run""")
def sessions(spark, d):
    e = table(spark, d, "events").withColumn("last", C("ts"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.max("last").alias("last"), F.count("*").alias("n")).select("user_id", C("w.start").cast("timestamp_ntz").alias("start"), "last", "n")


@query("funding_first_of_cycle", f"WITH {FUNDING_SQL} SELECT sym, d, min(seq) AS seq, round(arg_min(rate, seq) * 1e6, 7) AS rate FROM funding GROUP BY sym, d")
def first_of_cycle(spark, d):
    return funding(spark, d).groupBy("sym", "d").agg(F.min("seq").alias("seq"), F.round(F.min_by("rate", "seq") * 1e6, 7).alias("rate"))


@query("reconcile_books", """WITH a AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, round(coalesce(x, 0), 2) AS x, round(coalesce(y, 0), 2) AS y FROM a FULL JOIN b ON a.k = b.k WHERE abs(coalesce(x, 0) - coalesce(y, 0)) > greatest(1000, 0.1 * abs(coalesce(x, 0)))""")
def reconcile(spark, d):
    o = table(spark, d, "orders")
    side = lambda s, c: o.where(C("o_orderstatus") == s).groupBy(C("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias(c))
    j = side("F", "x").join(side("O", "y"), "k", "full").na.fill(0.0, ["x", "y"])
    return j.where(F.abs(C("x") - C("y")) > F.greatest(F.lit(1000.0), 0.1 * F.abs("x"))).select("k", "x", "y")


@query("dimension_join", "SELECT r_name, n_name, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dimension_join(spark, d):
    j = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), C("s_nationkey") == C("n_nationkey")).join(F.broadcast(table(spark, d, "region")), C("n_regionkey") == C("r_regionkey"))  # 25 and 5 rows at every scale
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("bal"))


@query("price_adjustments", f"""WITH {BARS_SQL}, f AS (SELECT sym, DATE '1997-06-01' AS e, 0.5 AS x FROM bars GROUP BY sym UNION ALL SELECT sym, DATE '1999-03-01', 0.8 FROM bars GROUP BY sym)
    SELECT b.sym, b.d, round(b.c * coalesce((SELECT exp(sum(ln(x))) FROM f WHERE f.sym = b.sym AND f.e > b.d), 1), 8) AS c FROM bars b""")
def adjustments(spark, d):
    b = bars_1d(spark, d).select("sym", "d", "c")
    f = b.select("sym").distinct().select("sym", F.explode(F.array(*(F.struct(F.lit(e).cast("date").alias("d"), F.lit(x).alias("factor")) for e, x in (("1997-06-01", 0.5), ("1999-03-01", 0.8))))).alias("f")).select("sym", "f.*")
    return out(T.apply_adjustments(b, f, ["c"], "sym", "d"), "sym", "d", digits=8, c=C("c"))


@query("bridge_holes", f"""WITH {BARS_SQL}, x AS (SELECT sym, d, CASE WHEN i % 11 NOT IN (3, 4) AND i % 37 NOT BETWEEN 20 AND 29 THEN c END AS c FROM rets), g AS (SELECT *, count(c) OVER (PARTITION BY sym ORDER BY d) AS n FROM x),
    k AS (SELECT *, count_if(c IS NULL) OVER (PARTITION BY sym, n) AS size, last_value(c IGNORE NULLS) OVER (PARTITION BY sym ORDER BY d) AS p, max(CASE WHEN c IS NOT NULL THEN d END) OVER (PARTITION BY sym) AS e FROM g)
    SELECT sym, d, round(CASE WHEN c IS NULL AND size <= 7 AND d < e THEN p ELSE c END, 8) AS c FROM k""")
def bridge(spark, d):
    x = rets(spark, d).select("sym", "d", F.when(~(C("i") % 11).isin(3, 4) & ~(C("i") % 37).between(20, 29), C("c")).alias("c"))
    return out(T.bridge_holes(x, "c", "sym", "d", 7), "sym", "d", digits=8, c=C("c"))


@query("duplicate_times", f"WITH {TICKS_SQL} SELECT sym, date_trunc('hour', ts) AS h, seq, row_number() OVER (PARTITION BY sym, date_trunc('hour', ts) ORDER BY ts, seq) - 1 AS k FROM ticks")
def duplicate_times(spark, d):
    t = ticks(spark, d).withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return t.select("sym", "h", "seq", (F.row_number().over(Window.partitionBy("sym", "h").orderBy("ts", "seq")) - 1).cast("long").alias("k"))


@query("quote_last_known", f"WITH {TICKS_SQL} SELECT sym, max_by(price, (ts, seq)) AS price, max(ts) AS ts, count(*) AS n FROM ticks WHERE side = 'buy' GROUP BY sym")
def quote_last(spark, d):
    return ticks(spark, d).where("side = 'buy'").groupBy("sym").agg(F.max_by("price", F.struct("ts", "seq")).alias("price"), F.max("ts").alias("ts"), F.count("*").alias("n"))


@query("ffill_cross_section", f"WITH {BARS_SQL} SELECT d, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS dispersion, round(max(CASE WHEN sym = 'NO' THEN r END) - avg(CASE WHEN sym <> 'NO' THEN r END), 6) AS lead FROM rets GROUP BY d")
def cross_features(spark, d):
    return rets(spark, d).groupBy("d").agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_pop("r"), 6).alias("dispersion"), F.round(F.max(F.when(C("sym") == "NO", C("r"))) - F.avg(F.when(C("sym") != "NO", C("r"))), 6).alias("lead"))


@query("top_k_per_series", f"WITH {BARS_SQL} SELECT sym, d, round(notional, 2) AS notional FROM bars QUALIFY row_number() OVER (PARTITION BY sym ORDER BY notional DESC, d) <= 5")
def top_k(spark, d):
    b = bars_1d(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("sym").orderBy(C("notional").desc(), "d")))
    return b.where("k <= 5").select("sym", "d", "notional")


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def set_difference(spark, d):
    recent = table(spark, d, "orders").where("o_orderdate >= timestamp'1997-01-01'").select("o_custkey")
    return table(spark, d, "customer").select(C("c_custkey").alias("k")).join(recent, C("k") == C("o_custkey"), "left_anti").distinct()


