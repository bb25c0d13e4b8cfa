"""Operators that no table of the folder shows fully: recursions, stores, streams."""

import datetime
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import sequential as S
from tidemark.operators import timeline as T
from tidemark.operators import windows as W
from tidemark.plans import research
from tidemark.sources import store
from tidemark.streaming import live

DAY = datetime.date(2020, 1, 1)


def series(n=200, seed=1):
    rng = random.Random(seed)
    price, out = 100.0, []
    for i in range(n):
        price *= 1 + rng.gauss(0, 0.02)
        out.append((i, price, float(rng.randrange(1, 9)), rng.choice([1, -1])))
    return out


def test_dollar_bars_conserve_volume(spark):
    rows = series()
    start, step = S.dollar_step(3000.0)
    state, bars = start(), []
    for i, p, q, _ in rows:
        bars += step(state, (i, p, q))
    assert len(bars) > 5
    assert abs(sum(b[5] for b in bars) + state["vol"] - sum(q for _, _, q, _ in rows)) < 1e-6
    df = spark.createDataFrame([("x", *r) for r in rows] + [("y", *r) for r in rows], "sym string, seq long, price double, qty double, sign int")
    names = ["sym", "at", "o", "h", "l", "c", "vol", "n"]
    got = S.fold(df, "sym", ["seq"], ["seq", "price", "qty"], *S.dollar_step(3000.0), "sym string, at long, o double, h double, l double, c double, vol double, n long", names, [pa.string(), pa.int64(), *[pa.float64()] * 5, pa.int64()])
    assert sorted(tuple(r) for r in got.collect()) == sorted((s, *b) for s in "xy" for b in bars)


def test_runs_bars_reset_one_side():
    start, step = S.runs_step(10.0)
    state = start()
    for i, (q, sign) in enumerate([(6.0, 1), (3.0, -1), (6.0, 1)]):
        out = step(state, (i, 1.0, q, sign))
    assert out and state["buys"] == 2.0 and state["sells"] == 3.0


def test_ledger():
    start, step = S.ledger_step()
    state = start()
    for row in [(0, 10.0, 2.0), (1, 20.0, 2.0), (2, 30.0, -3.0), (3, 10.0, -2.0)]:
        out = step(state, row)
    assert out == [(3, -1.0, 10.0, 45.0 - 5.0)]


def test_asof_needs_a_tolerance(spark):
    left = spark.createDataFrame([("a", 5), ("a", 9), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 3, 2.0), ("b", 1, None)], "k string, t long, v double")
    got = {(r["k"], r["t"]): r["v"] for r in T.asof_join(left, right, "t", ["k"], ["v"], F.lit(3)).collect()}
    assert got == {("a", 5): 1.0, ("a", 9): None, ("b", 5): None}
    with pytest.raises(ValueError):
        T.asof_join(left, right, "t", ["k"], ["v"], None)


def test_store_is_append_only(spark, tmp_path):
    path = str(tmp_path / "pit")
    schema = "event_ts_ns long, asof_ts_ns long, close double, asset_class string, dataset string, symbol string, granularity string, date string"
    rows = [(i, i + 1, float(i), "x", "ohlcv", s, "1d", "2020") for i in range(5) for s in ("A", "B")]
    df = spark.createDataFrame(rows, schema)
    assert store.append(df, path) == 2 and store.append(df, path) == 0
    assert store.append(spark.createDataFrame([(1, 2, 1.0, "x", "ohlcv", "C", "1d", "2020")], schema), path) == 1
    with pytest.raises(store.ContractError):
        store.append(df.withColumn("close", F.col("close") + 1), path)
    with pytest.raises(store.ContractError):
        store.append(df.withColumn("asof_ts_ns", F.lit(-1).cast("long")), path)
    assert store.load(spark, path, df.schema, symbol="A").count() == 5


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(tuple(r) for r in store.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def files(e, path, latest_first=False):
    """Three files of events by day, written one after the other: the file source reads them in that order."""
    days = [r["d"] for r in e.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()][:: -1 if latest_first else 1]
    size = -(-len(days) // 3)
    for i in range(0, len(days), size):
        e.where(F.to_date("ts").isin(days[i : i + size])).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


@pytest.fixture
def stream(spark, sf, tmp_path):
    path = str(tmp_path / "events")
    files(spark.read.parquet(f"{sf}/events.parquet"), path)
    return path


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.awaitTermination(60)
    return df.sparkSession.table(name)


def test_streamed_bars_are_the_batch_bars(spark, sf, stream):
    from tidemark.plans.features import tick_bars
    from tidemark.sources.tables import ticks

    got = drain(live.tumbling_bars(live.tick_stream(spark, stream), "1 hour", "10 minutes"), "bars", "append")
    batch = tick_bars(ticks(spark, sf), "1 hour", "left").withColumn("ts", F.col("ts").cast("timestamp")).select(*got.columns)
    assert got.count() > 0 and got.exceptAll(batch).isEmpty()


def test_streamed_last_quotes(spark, sf, stream):
    got = {r["sym"]: (r["price"], r["n"]) for r in drain(live.last_quotes(live.tick_stream(spark, stream, 9)), "quotes", "complete").collect()}
    from tidemark.sources.tables import ticks

    want = ticks(spark, sf).groupBy("sym").agg(F.max_by("price", F.struct("ts", "seq")).alias("p"), F.count("*").alias("n")).collect()
    assert got == {r["sym"]: (r["p"], r["n"]) for r in want}


def test_streamed_events_are_the_batch_events(spark, sf, tmp_path):
    """One step function, two drivers. Files arrive in the wrong order; a last row, far ahead, moves the watermark past all others."""
    path = str(tmp_path / "events")
    e = spark.read.parquet(f"{sf}/events.parquet")
    files(e, path, latest_first=True)
    e.limit(1).withColumn("ts", F.expr("timestamp_ntz'2031-01-01'")).withColumn("event_type", F.lit("end")).coalesce(1).write.mode("append").parquet(path)
    start, step = S.cusum_step(50.0)
    t = live.tick_stream(spark, path)
    got = drain(live.stateful(t, "sym", ["ts", "seq"], ["seq", "price"], start, step, "sym string, at long, side int", "last double, up double, down double", late="60 days"), "events", "append")
    from tidemark.sources.tables import ticks

    want = S.fold(ticks(spark, sf), "sym", ["ts", "seq"], ["seq", "price"], *S.cusum_step(50.0), "sym string, at long, side int", ["sym", "at", "side"], [pa.string(), pa.int64(), pa.int32()])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_streamed_sessions_and_dedup(spark, sf, tmp_path):
    path = str(tmp_path / "events")
    e = spark.read.parquet(f"{sf}/events.parquet").limit(400)
    e.union(e).coalesce(1).write.parquet(path)
    e.limit(1).withColumn("ts", F.expr("timestamp_ntz'2031-01-01'")).withColumn("event_id", F.lit(-1).cast("long")).coalesce(1).write.mode("append").parquet(path)
    t = live.deduplicated(live.tick_stream(spark, path, 9), "1 hour")
    got = drain(t, "single", "append")
    assert got.count() == 401
    found = drain(live.sessions(live.tick_stream(spark, path, 1), "30 minutes", "1 hour"), "sessions", "append")
    assert sum(r["n"] for r in found.collect()) == 800


def run_steps(maker, rows):
    start, step = maker
    state = start()
    return [x for row in rows for x in step(state, row)]


def test_imbalance_steps():
    bars = run_steps(S.imbalance_step(10.0), [(1, 5.0, 6.0, 1), (2, 7.0, 6.0, 1), (3, 6.0, 4.0, -1), (4, 4.0, 9.0, -1)])
    assert bars == [(2, 5.0, 7.0, 5.0, 7.0, 12.0, 2), (4, 7.0, 7.0, 4.0, 4.0, 13.0, 2)]  # 12 closes, 2 stay: 2 - 4 - 9 = -11


def test_kalman_steps():
    (a, x, p), (b, y, q) = run_steps(S.kalman_step(0.5, 1.0), [(1, 2.0), (2, 5.0)])
    assert (a, x, p, b) == (1, 2.0, 1.0, 2) and abs(y - (2 + 3 * 0.6)) < 1e-12 and abs(q - 0.6) < 1e-12


def test_breaker_steps():
    found = run_steps(S.breaker_step(0.2, 0.1), [(1, 100.0), (2, 85.0), (3, 79.0), (4, 88.0), (5, 91.0)])
    assert [h for *_, h in found] == [False, False, True, True, False]


def test_ewm_steps():
    values = [1.0, None, 3.0, 4.0]
    want = pd.Series(values)
    for adjust in (True, False):
        got = [v for _, v in run_steps(S.ewm_step(0.3, adjust), list(enumerate(values)))]
        assert np.allclose(got, want.ewm(alpha=0.3, adjust=adjust).mean())


def test_seeded_variance_steps():
    got = [v for _, v in run_steps(S.seeded_variance_step(0.9, 2), [(0, None), (1, 1.0), (2, 3.0), (3, 2.0), (4, 0.0)])]
    assert got[:3] == [None] * 3 and np.allclose(got[3:], [5.0, 0.9 * 5 + 0.1 * 4])


def test_running_sums(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "i long, x double")
    found = W.running_max(W.running(df, "i", F.floor(F.col("i") / 9), total=F.col("x")), "i", "top", "x").orderBy("i").collect()
    assert [r["total"] for r in found] == list(np.cumsum([i % 7 for i in range(100)])) and [r["top"] for r in found][:8] == [0, 1, 2, 3, 4, 5, 6, 6]


def test_ruin_stays_ruin(spark):
    days = [("2020-01-01", 0.5), ("2020-01-20", -1.2), ("2020-02-03", 0.3)]
    p = spark.createDataFrame(days, "d string, net double").withColumn("d", F.to_date("d"))
    found = research.equity(p).orderBy("d").collect()
    assert [r["le"] for r in found][1:] == [None, None] and [r["ruined"] for r in found] == [False, True, True] and [r["drawdown"] for r in found] == [0.0, 1.0, 1.0]


def test_streams_settle_once_and_report(spark, sf, stream, tmp_path):
    metrics, seen = live.Metrics(), []
    spark.streams.addListener(metrics)
    path = str(tmp_path / "out")
    write, send = live.once(path), live.routed({"buy": seen.append}, "side", 2)

    def both(batch, number):
        write(batch, number)
        write(batch, number)  # a batch that runs again
        send(batch, number)

    q = live.tick_stream(spark, stream).writeStream.foreachBatch(both).trigger(availableNow=True).start()
    q.awaitTermination(60)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert spark.read.parquet(path).count() == n and all(len(x) <= 3 for x in seen) and len(seen) == 3
    batches = lambda: [r["batch"] for r in metrics.records if r.get("rows")]
    for _ in range(50):
        if len(batches()) == 3:
            break
        time.sleep(0.1)
    spark.streams.removeListener(metrics)
    assert batches() == [0, 1, 2]
