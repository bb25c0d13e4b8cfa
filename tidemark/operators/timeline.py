"""Temporal alignment: as-of joins with a tolerance, interval sums, spines, gaps, memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], tolerance: Column, order: str | None = None, right_on: str | None = None, suffix: str = "") -> DataFrame:
    """For each left row the last right row with right_on <= on, no older than the tolerance (an interval or a number).

    Union and one ordered window: one shuffle by the keys, no range join. Right rows come before left rows of the same time.
    """
    if tolerance is None:
        raise ValueError("an as-of join needs a finite tolerance")
    right_on = right_on or on
    seq = F.col(order) if order else F.lit(0)
    packed = F.struct(F.col(right_on).alias("_t"), *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values)))
    r = right.select(*by, F.col(right_on).alias("_on"), seq.cast("long").alias("_seq"), packed.alias("_right"), F.lit(0).alias("_side"))
    kept = [c for c in left.columns if c not in by]
    l_ = left.select(*by, F.col(on).alias("_on"), F.lit(0).cast("long").alias("_seq"), F.lit(1).alias("_side"), F.struct(*kept).alias("_left"))
    both = l_.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_on", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.col("_last._t") >= F.col("_on") - tolerance
    return found.select(*by, "_left.*", *(F.when(fresh, F.col(f"_last._v{i}")).alias(v + suffix) for i, v in enumerate(values)))


def interval_sums(events: DataFrame, spine: DataFrame, value: str, by: str, event_day: str, bar_day: str) -> DataFrame:
    """Sum of the events of the day before each bar's end, 0 where there is none: events move to the bar they settle at, then one equi-join."""
    daily = events.groupBy(F.col(by).alias("_by"), F.date_add(event_day, 1).alias("_day")).agg(F.sum(value).alias("_sum"))
    joined = spine.join(daily, (spine[by] == daily["_by"]) & (spine[bar_day] == daily["_day"]), "left")
    return joined.withColumn("settled", F.coalesce("_sum", F.lit(0.0))).drop("_by", "_day", "_sum")


def spine(df: DataFrame, by: str, day: str) -> DataFrame:
    """Each series' days from its first to its last."""
    return df.groupBy(by).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).select(by, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))


def fill_forward(df: DataFrame, columns: list[str], by: str, day: str, limit: int | None = None) -> DataFrame:
    """Last known values, over at most limit rows."""
    lo = Window.unboundedPreceding if limit is None else -limit
    w = Window.partitionBy(by).orderBy(day).rowsBetween(lo, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def gaps(df: DataFrame, by: str, day: str) -> DataFrame:
    """Holes of a daily series: the days around a hole and how many are missing."""
    w = Window.partitionBy(by).orderBy(day)
    return df.select(by, F.lag(day).over(w).alias("gap_start"), F.col(day).alias("gap_end")).withColumn("n_missing", F.datediff("gap_end", "gap_start") - 1).where("n_missing > 0")


def bridge_holes(df: DataFrame, value: str, by: str, day: str, longest: int) -> DataFrame:
    """Fills inner runs of nulls of at most longest rows with the value before; other nulls stay."""
    w = Window.partitionBy(by).orderBy(day)
    n = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = Window.partitionBy(by, "_n")
    size = F.sum(F.col(value).isNull().cast("int")).over(run)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max(F.when(F.col(value).isNotNull(), F.col(day))).over(Window.partitionBy(by))
    return df.withColumn("_n", n).withColumn(value, F.when(F.col(value).isNull() & (size <= longest) & (F.col(day) < last), before).otherwise(F.col(value))).drop("_n")


def membership(events: DataFrame, days: DataFrame, by: str, ts: str, action: str, day: str) -> DataFrame:
    """For each day the members: the last event up to it decides. Validity intervals, joined as an as-of."""
    return asof_join(days, events, day, [by], [action], F.lit(100_000), right_on=ts).where(F.col(action) == "add")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the last row: a map-side reducible max of structs instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def apply_adjustments(bars: DataFrame, factors: DataFrame, price: list[str], by: str, day: str) -> DataFrame:
    """Prices before an effective day, times all later factors. factors: by, day, factor; few per series, so one window over the union."""
    f = factors.select(by, day, F.log("factor").alias("_f"))
    both = bars.withColumn("_f", F.lit(None).cast("double")).unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(F.col(day).desc(), F.col("_f").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    k = F.exp(F.coalesce(F.sum("_f").over(w), F.lit(0.0)))
    return both.withColumn("_k", k).where("_f is null").withColumns({p: F.col(p) * F.col("_k") for p in price}).drop("_f", "_k")
