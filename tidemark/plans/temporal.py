"""Predicates, strings and dates, further joins over time, quality rules and slices of a history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import timeline as T
from tidemark.operators import windows as W
from tidemark.plans.features import rets
from tidemark.plans.registry import out, query
from tidemark.sources.tables import BARS_SQL, FUNDING_SQL, TICKS_SQL, bars_1d, funding, table, ticks

C = F.col

# Predicates, dates, strings


@query("select_symbols", f"WITH {BARS_SQL} SELECT sym, d, round(c, 8) AS c FROM bars WHERE sym IN ('AF', 'RO') AND d >= DATE '1998-01-01'")
def select_symbols(spark, d):
    return bars_1d(spark, d).where(C("sym").isin("AF", "RO") & (C("d") >= "1998-01-01")).select("sym", "d", F.round("c", 8).alias("c"))


@query("local_hours", f"WITH {TICKS_SQL} SELECT sym, CAST(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS INT) AS h, count(*) AS n FROM ticks GROUP BY ALL")
def local_hours(spark, d):
    """Ticks by the hour of another zone."""
    return ticks(spark, d).groupBy("sym", F.hour(F.from_utc_timestamp(C("ts").cast("timestamp"), "America/New_York")).alias("h")).agg(F.count("*").alias("n"))


@query("calendar_labels", f"WITH {BARS_SQL} SELECT sym, d, strftime(d, '%Y%m%d') AS label, strftime(d, '%Y-%m') AS month, CAST(isodow(d) - 1 AS INT) AS weekday, CAST(quarter(d) AS INT) AS q FROM bars")
def calendar_labels(spark, d):
    return bars_1d(spark, d).select("sym", "d", F.date_format("d", "yyyyMMdd").alias("label"), F.date_format("d", "yyyy-MM").alias("month"), F.weekday("d").alias("weekday"), F.quarter("d").alias("q"))


@query(
    "symbol_strings",
    r"""WITH s AS (SELECT DISTINCT o_orderpriority AS p FROM orders) SELECT p, CAST(regexp_extract(p, '^(\d+)', 1) AS INT) AS rank, lower(regexp_replace(substr(p, 3), '[^A-Za-z]+', '_', 'g')) AS name,
    starts_with(p, '1') AS first, ends_with(p, 'W') AS low, regexp_matches(p, '^[12]-') AS rush, upper(substr(p, 3, 1)) || '.' AS initial FROM s""",
)
def symbol_strings(spark, d):
    """Prefixes, suffixes, patterns and case folding."""
    p = C("o_orderpriority")
    s = table(spark, d, "orders").select(p.alias("p")).distinct()
    return s.select(
        "p", F.regexp_extract("p", r"^(\d+)", 1).cast("int").alias("rank"), F.lower(F.regexp_replace(F.expr("substr(p, 3)"), "[^A-Za-z]+", "_")).alias("name"), C("p").startswith("1").alias("first"), C("p").endswith("W").alias("low"),
        C("p").rlike("^[12]-").alias("rush"), F.concat(F.upper(F.substring("p", 3, 1)), F.lit(".")).alias("initial"),
    )


@query("scaled_symbols", r"""SELECT n_name, CASE WHEN regexp_matches(s, '^1000') THEN substr(s, 5) ELSE s END AS base, CASE WHEN regexp_matches(s, '^1000') THEN 1000 ELSE 1 END AS factor FROM (SELECT n_name, CASE WHEN n_nationkey % 4 = 0 THEN '1000' ELSE '' END || n_name AS s FROM nation)""")
def scaled_symbols(spark, d):
    """Contracts of a thousand units: their base and the factor between them."""
    s = F.concat(F.when(C("n_nationkey") % 4 == 0, "1000").otherwise(""), "n_name")
    n = table(spark, d, "nation").select("n_name", s.alias("s"))
    return n.select("n_name", F.when(C("s").startswith("1000"), F.expr("substr(s, 5)")).otherwise(C("s")).alias("base"), F.when(C("s").startswith("1000"), 1000).otherwise(1).alias("factor"))


@query("volume_backfill", f"WITH {BARS_SQL}, x AS (SELECT sym, d, CASE WHEN i % 5 = 0 THEN vol END AS v FROM rets) SELECT sym, d, first_value(v IGNORE NULLS) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM x")
def volume_backfill(spark, d):
    """The next known value; looks ahead, so for reports alone."""
    ahead = W.series().rowsBetween(0, Window.unboundedFollowing)
    return rets(spark, d).withColumn("v", F.when(C("i") % 5 == 0, C("vol"))).select("sym", "d", F.first("v", ignorenulls=True).over(ahead).alias("v"))


@query("distinct_users", "SELECT event_type, count(DISTINCT user_id) AS users, min(user_id) AS first, max(user_id) AS last, string_agg(DISTINCT CAST(user_id % 7 AS VARCHAR), ',' ORDER BY CAST(user_id % 7 AS VARCHAR)) AS kinds FROM events GROUP BY event_type")
def distinct_users(spark, d):
    kinds = F.concat_ws(",", F.sort_array(F.collect_set((C("user_id") % 7).cast("string"))))
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.min("user_id").alias("first"), F.max("user_id").alias("last"), kinds.alias("kinds"))


@query(
    "minutes_to_open",
    f"WITH {TICKS_SQL}, m AS (SELECT sym, hour(ts) * 60 + minute(ts) AS m, isodow(ts) AS w FROM ticks) SELECT sym, CAST(CASE WHEN w >= 6 THEN 870 + (8 - w) * 1440 - m WHEN m < 870 THEN 870 - m WHEN m < 1260 THEN 0 WHEN w = 5 THEN 870 + 3 * 1440 - m ELSE 870 + 1440 - m END AS INT) AS wait, count(*) AS n FROM m GROUP BY ALL",
)
def minutes_to_open(spark, d):
    """Minutes until a market that is open from 14:30 to 21:00 on weekdays; 0 while it is."""
    m = F.hour("ts") * 60 + F.minute("ts")
    w = F.weekday("ts") + 1
    wait = F.when(w >= 6, 870 + (8 - w) * 1440 - m).when(m < 870, 870 - m).when(m < 1260, 0).when(w == 5, 870 + 3 * 1440 - m).otherwise(870 + 1440 - m)
    return ticks(spark, d).groupBy("sym", wait.alias("wait")).agg(F.count("*").alias("n"))


@query("index_union", f"WITH {BARS_SQL}, a AS (SELECT d, c FROM bars WHERE sym = 'AF'), b AS (SELECT d, c FROM bars WHERE sym = 'RO' AND vol > 100) SELECT coalesce(a.d, b.d) AS d, round(a.c, 8) AS x, round(b.c, 8) AS y FROM a FULL JOIN b ON a.d = b.d")
def index_union(spark, d):
    """Two series on the union of their days."""
    b = bars_1d(spark, d)
    x, y = b.where("sym = 'AF'").select("d", F.round("c", 8).alias("x")), b.where("sym = 'RO' and vol > 100").select("d", F.round("c", 8).alias("y"))
    return x.join(y, "d", "full").select("d", "x", "y")


# Joins over time

OI_SQL = "oi AS (SELECT CASE o_custkey % 6 WHEN 0 THEN 'AF' WHEN 1 THEN 'AO' WHEN 2 THEN 'NF' WHEN 3 THEN 'NO' WHEN 4 THEN 'RF' ELSE 'RO' END AS sym, CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS oi FROM orders GROUP BY ALL)"


def open_interest(spark, d) -> DataFrame:
    """A level for each series and day, with holes."""
    f = funding(spark, d).withColumn("x", C("rate") * 1e9 + 250000)
    return f.groupBy("sym", "d").agg(F.round(F.sum("x"), 2).alias("oi"))


@query(
    "certified_frame",
    f"""WITH {BARS_SQL}, {FUNDING_SQL}, {OI_SQL}, u AS (SELECT sym, d, max_by(rate, seq) AS rate FROM funding GROUP BY sym, d),
    x AS (SELECT b.sym, b.d, b.c, CASE WHEN b.d - u.d <= 2 THEN u.rate END AS rate FROM bars b ASOF LEFT JOIN u ON b.sym = u.sym AND b.d >= u.d)
    SELECT x.sym, x.d, round(x.c, 8) AS c, round(x.rate * 1e6, 7) AS rate, CASE WHEN x.d - oi.d <= 3 THEN oi.oi END AS oi FROM x ASOF LEFT JOIN oi ON x.sym = oi.sym AND x.d >= oi.d""",
)
def certified_frame(spark, d):
    """Bars with the funding and the open interest that were known by then, each with a tolerance of its own."""
    x = T.asof_join(bars_1d(spark, d).select("sym", "d", "c"), funding(spark, d), "d", ["sym"], ["rate"], F.expr("interval 2 days"), order="seq")
    x = T.asof_join(x, open_interest(spark, d), "d", ["sym"], ["oi"], F.expr("interval 3 days"))
    return x.select("sym", "d", F.round("c", 8).alias("c"), F.round(C("rate") * 1e6, 7).alias("rate"), "oi")


@query("oi_last_known", f"WITH {BARS_SQL}, {OI_SQL} SELECT b.sym, b.d, coalesce(oi.oi, 0) AS oi FROM bars b ASOF LEFT JOIN oi ON b.sym = oi.sym AND b.d >= oi.d")
def oi_last_known(spark, d):
    """The last known level however old it is, 0 before the first."""
    x = T.asof_join(bars_1d(spark, d).select("sym", "d"), open_interest(spark, d), "d", ["sym"], ["oi"], F.expr("interval 100000 days"))
    return x.select("sym", "d", F.coalesce("oi", F.lit(0.0)).alias("oi"))


BASIS_SQL = f"{BARS_SQL}, perp AS (SELECT sym, d, c, h, l, vol FROM bars WHERE sym LIKE '%F'), spot AS (SELECT replace(sym, 'O', 'F') AS sym, d, c AS s, h AS sh, l AS sl FROM bars WHERE sym LIKE '%O')"


def legs(spark, d) -> tuple[DataFrame, DataFrame]:
    """The perpetual series, and the spot series under their names."""
    b = bars_1d(spark, d)
    return b.where(C("sym").endswith("F")).select("sym", "d", "c", "h", "l", "vol"), b.where(C("sym").endswith("O")).select(F.translate("sym", "O", "F").alias("sym"), "d", C("c").alias("s"), C("h").alias("sh"), C("l").alias("sl"))


@query("basis_market", f"WITH {BASIS_SQL} SELECT sym, d, round(c, 8) AS perp, round(s, 8) AS spot, round(c / s - 1, 6) AS basis FROM perp LEFT JOIN spot USING (sym, d)")
def basis_market(spark, d):
    """The spot leg on the perpetual's days; missing days stay null."""
    perp, spot = legs(spark, d)
    return perp.join(spot, ["sym", "d"], "left").select("sym", "d", F.round("c", 8).alias("perp"), F.round("s", 8).alias("spot"), F.round(F.try_divide("c", "s") - 1, 6).alias("basis"))


@query("margin_market", f"WITH {BASIS_SQL}, m AS (SELECT sym, d, h AS mh, l AS ml FROM perp WHERE vol > 60) SELECT sym, d, round(mh, 8) AS mark_high, round(ml, 8) AS mark_low, round(sh, 8) AS spot_high, round(sl, 8) AS spot_low FROM perp LEFT JOIN m USING (sym, d) LEFT JOIN spot USING (sym, d)")
def margin_market(spark, d):
    """Extremes of the mark price and of the spot leg on the perpetual's days."""
    perp, spot = legs(spark, d)
    mark = perp.where("vol > 60").select("sym", "d", C("h").alias("mh"), C("l").alias("ml"))
    x = perp.select("sym", "d").join(mark, ["sym", "d"], "left").join(spot, ["sym", "d"], "left")
    return x.select("sym", "d", F.round("mh", 8).alias("mark_high"), F.round("ml", 8).alias("mark_low"), F.round("sh", 8).alias("spot_high"), F.round("sl", 8).alias("spot_low"))


@query("stacked_blocks", f"WITH {BARS_SQL}, m AS (SELECT sym, date_trunc('month', d)::DATE AS m, avg(c) AS macro FROM bars GROUP BY ALL), e AS (SELECT sym, d, avg(c) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS meso FROM bars) SELECT b.sym, b.d, round(b.c, 8) AS feat_c, round(e.meso, 6) AS feat_c_meso, round(m.macro, 6) AS feat_macro_c FROM bars b JOIN e USING (sym, d) LEFT JOIN m ON m.sym = b.sym AND m.m = (date_trunc('month', b.d) - INTERVAL 1 MONTH)::DATE")
def stacked_blocks(spark, d):
    return stacked(spark, d)


def stacked(spark, d) -> DataFrame:
    """Blocks of features of three horizons side by side: the bar's own, a trailing mean, the month before."""
    b = bars_1d(spark, d)
    macro = b.groupBy("sym", F.add_months(F.trunc("d", "month"), 1).alias("m")).agg(F.avg("c").alias("macro"))
    x = b.withColumn("meso", F.avg("c").over(W.trailing(10))).withColumn("m", F.trunc("d", "month")).join(macro, ["sym", "m"], "left")
    return x.select("sym", "d", F.round("c", 8).alias("feat_c"), F.round("meso", 6).alias("feat_c_meso"), F.round("macro", 6).alias("feat_macro_c"))


def feature_map(columns: list[str]) -> dict[str, list[str]]:
    """Feature columns by the conventions of their names: feat_macro_ in front, _macro or _meso behind, others are micro."""
    found: dict[str, list[str]] = {"micro": [], "meso": [], "macro": []}
    for c in columns:
        if c.startswith("feat_"):
            found["macro" if c.startswith("feat_macro_") or c.endswith("_macro") else "meso" if c.endswith("_meso") else "micro"].append(c)
    return found


@query("feature_blocks", f"WITH {BARS_SQL}, e AS (SELECT sym, d, c, avg(c) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS meso, count(*) OVER (PARTITION BY sym, date_trunc('month', d)) AS n FROM bars) SELECT 'meso' AS block, 'feat_c_meso' AS feature, count(meso) AS n FROM e UNION ALL SELECT 'micro', 'feat_c', count(c) FROM e UNION ALL SELECT 'macro', 'feat_macro_c', count(*) FROM bars b JOIN (SELECT DISTINCT sym, date_trunc('month', d) AS m FROM bars) m ON m.sym = b.sym AND m.m = date_trunc('month', b.d) - INTERVAL 1 MONTH")
def feature_blocks(spark, d):
    """Rows of each block of features, split by name."""
    x = stacked(spark, d)
    n = x.agg(*(F.count(c).alias(c) for c in x.columns if c.startswith("feat_")))
    rows = [F.struct(F.lit(block).alias("block"), F.lit(c).alias("feature"), C(c).alias("n")) for block, cs in feature_map(x.columns).items() for c in cs]
    return n.select(F.inline(F.array(*rows)))


@query("market_slices", f"WITH {BARS_SQL}, s AS (SELECT sym, d, stddev_samp(lr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s, count(lr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n, c FROM rets) SELECT d, count(*) AS n, string_agg(sym || '=' || CAST(floor(c) AS BIGINT), ',' ORDER BY sym) AS marks FROM s WHERE n >= 20 GROUP BY d")
def market_slices(spark, d):
    """Of each day a map of the marks of the symbols that have a volatility, written out by symbol."""
    s = rets(spark, d).withColumn("s", W.rolling(C("lr"), "std", 20)).where("s is not null")
    m = s.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("sym", F.floor("c").alias("c")))).alias("marks"))
    said = F.transform(F.sort_array(F.map_entries("marks")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("d", F.size("marks").cast("long").alias("n"), F.concat_ws(",", said).alias("marks"))


@query(
    "event_space_exit",
    f"""WITH {BARS_SQL}, e AS (SELECT sym, i, row_number() OVER (PARTITION BY sym ORDER BY i) - 1 AS k, i + 5 + i % 7 AS x FROM rets WHERE abs(r) > 0.5)
    SELECT a.sym, CAST(a.k AS BIGINT) AS k, max(b.k) AS t1 FROM e a JOIN e b ON a.sym = b.sym AND b.i <= a.x GROUP BY a.sym, a.k""",
)
def event_space_exit(spark, d):
    """The number of the last event at or before each event's exit bar: an as-of join of exits with events."""
    e = rets(spark, d).where("abs(r) > 0.5").select("sym", C("i").cast("long").alias("i"), (C("i") + 5 + C("i") % 7).cast("long").alias("x"))
    e = e.withColumn("k", (F.row_number().over(Window.partitionBy("sym").orderBy("i")) - 1).cast("long"))
    found = T.asof_join(e.select("sym", "k", "x"), e.select("sym", C("k").alias("t1"), "i"), "x", ["sym"], ["t1"], F.lit(1 << 40), right_on="i")
    return found.select("sym", "k", "t1")


# Quality rules and slices


@query("gap_policy", f"WITH {BARS_SQL}, g AS (SELECT sym, d - lag(d) OVER (PARTITION BY sym ORDER BY d) - 1 AS n FROM bars) SELECT sym, count_if(n > 0) AS gaps, CASE WHEN max(n) > 3 THEN 'reject' WHEN count_if(n > 0) > 0 THEN 'register' ELSE 'accept' END AS verdict FROM g GROUP BY sym")
def gap_policy(spark, d):
    """Series with a hole of more than three days are rejected, others with holes go into the ledger."""
    n = F.datediff("d", F.lag("d").over(W.series())) - 1
    g = bars_1d(spark, d).select("sym", n.alias("n")).groupBy("sym").agg(F.count_if(C("n") > 0).alias("gaps"), F.max("n").alias("longest"))
    return g.select("sym", "gaps", F.when(C("longest") > 3, "reject").when(C("gaps") > 0, "register").otherwise("accept").alias("verdict"))


@query(
    "continuity_report",
    f"""WITH {BARS_SQL}, l AS (SELECT sym, min(d) + 30 AS a, max(d) - 30 AS b FROM bars GROUP BY sym), x AS (SELECT r.sym, r.d, lr, r.d < a OR r.d > b AS outside FROM rets r JOIN l USING (sym))
    SELECT sym, count_if(outside) AS outside, count_if(abs(lr) > 1.5) AS jumps, round(exp(max_by(lr, abs(lr))), 4) AS factor FROM x GROUP BY sym""",
)
def continuity_report(spark, d):
    """Bars outside the time a series is listed, and jumps that look like a change of the contract, with the factor of the largest."""
    b = rets(spark, d)
    life = b.groupBy("sym").agg(F.date_add(F.min("d"), 30).alias("a"), F.date_sub(F.max("d"), 30).alias("b"))
    x = b.join(F.broadcast(life), "sym").withColumn("outside", (C("d") < C("a")) | (C("d") > C("b")))  # a row for each symbol
    return x.groupBy("sym").agg(F.count_if("outside").alias("outside"), F.count_if(F.abs("lr") > 1.5).alias("jumps"), F.round(F.exp(F.max_by("lr", F.abs("lr"))), 4).alias("factor"))


SPLIT = "1999-06-01"


def development_slice(df: DataFrame, day: str, split: str = SPLIT) -> DataFrame:
    """Rows before the frozen split."""
    return df.where(F.col(day) < F.lit(split).cast("date"))


@query("development_slice", f"WITH {BARS_SQL} SELECT sym, count(*) AS n, max(d) AS last FROM bars WHERE d < DATE '{SPLIT}' GROUP BY sym")
def development(spark, d):
    return development_slice(bars_1d(spark, d), "d").groupBy("sym").agg(F.count("*").alias("n"), F.max("d").alias("last"))


@query("cost_aware_target", f"WITH {BARS_SQL}, x AS (SELECT sym, d, lead(c, 5) OVER (PARTITION BY sym ORDER BY d) / c - 1 AS r FROM bars) SELECT sym, d, CASE WHEN r - 0.002 > 0 THEN 1 ELSE 0 END AS y, round(r - 0.002, 6) AS net FROM x WHERE r IS NOT NULL")
def cost_aware_target(spark, d):
    """1 where the return is positive behind the cost of both trades."""
    x = bars_1d(spark, d).withColumn("r", F.try_divide(F.lead("c", 5).over(W.series()), C("c")) - 1).where("r is not null")
    return x.select("sym", "d", (C("r") - 0.002 > 0).cast("int").alias("y"), F.round(C("r") - 0.002, 6).alias("net"))


@query("selected_events", f"WITH {BARS_SQL}, x AS (SELECT sym, d, r, avg(vol) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v, vol FROM rets) SELECT sym, d, CASE WHEN r > 0 THEN 1 ELSE -1 END AS side FROM x WHERE abs(r) > 0.5 AND vol > v")
def selected_events(spark, d):
    """Events that a mask keeps, in step with their labels."""
    x = rets(spark, d).withColumn("v", F.avg("vol").over(W.series().rowsBetween(-20, -1)))
    return x.where((F.abs("r") > 0.5) & (C("vol") > C("v"))).select("sym", "d", F.when(C("r") > 0, 1).otherwise(-1).alias("side"))


# Slots with memory


def _targets(name: str, size: int, step: int):
    """Greedy slots over months: holders stay while their carry is above the exit, free slots go to the best carries above the entry. step: slots that open at most in a month."""

    @query(name)
    def run(spark, d):
        m = funding(spark, d).groupBy("sym", F.trunc("d", "month").alias("m")).agg((F.avg("rate") * 1e6).alias("x"))
        months = m.groupBy("m").agg(F.sort_array(F.collect_list(F.struct((-C("x")).alias("low"), "sym"))).alias("ranked"))  # a few symbols a month
        state = months.agg(F.sort_array(F.collect_list(F.struct("m", "ranked"))).alias("all"))  # a row for each month
        none = F.expr("cast(array() as array<struct<m: date, held: array<string>>>)")

        def step_(acc, x):
            held = F.coalesce(F.try_element_at(acc, F.lit(-1))["held"], F.expr("cast(array() as array<string>)"))
            stays = F.transform(F.filter(x["ranked"], lambda e: F.array_contains(held, e["sym"]) & (e["low"] < 2)), lambda e: e["sym"])
            new = F.transform(F.filter(x["ranked"], lambda e: ~F.array_contains(held, e["sym"]) & (e["low"] < -2)), lambda e: e["sym"])
            room = F.greatest(F.lit(0), F.least(F.lit(step), size - F.size(stays)))
            return F.concat(acc, F.array(F.struct(x["m"].alias("m"), F.concat(stays, F.slice(new, F.lit(1), room)).alias("held"))))

        done = state.select(F.aggregate("all", none, step_).alias("all")).select(F.inline("all"))
        return done.select("m", F.size("held").alias("n"), F.concat_ws(",", F.sort_array("held")).alias("held"))


_targets("harvest_targets", 3, 3)
_targets("tranche_targets", 3, 1)
