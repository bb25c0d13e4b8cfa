"""Readers over files, ledgers, gates of slices and the way into the store."""

import gzip

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ledger, parsers, store


def test_klines_from_gzipped_files(spark, tmp_path):
    rows = "open_time,open,high,low,close,volume,close_time,x\n1577836800000,1,2,0.5,1.5,10,1577923199999,0\n1735689600000000,2,3,1,2.5,20,0,0\nbroken\n"
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write(rows)
    got = parsers.klines(parsers.lines(spark, str(tmp_path))).orderBy("ts").collect()
    assert [(r["file"], r["ts"], r["o"], r["h"], r["l"], r["c"], r["vol"]) for r in got] == [("a.csv.gz", 1577836800000, 1.0, 2.0, 0.5, 1.5, 10.0), ("a.csv.gz", 1735689600000, 2.0, 3.0, 1.0, 2.5, 20.0)]


def test_rates(spark):
    lines = spark.createDataFrame([("observation_date,DTB3",), ("2020-01-02,1.52",), ("2020-01-03,.",), ("2021-01-04,1.5",), (None,), ("",)], "line string")
    got = parsers.treasury_rates(lines, "2020-12-31").orderBy("d").collect()
    assert [(str(r["d"]), r["rate"]) for r in got] == [("2020-01-02", 0.0152), ("2020-01-03", None)]


def test_payloads_that_are_none(spark):
    docs = spark.createDataFrame([("a", '{"rates": []}'), ("b", None), ("c", "no json")], "sym string, payload string")
    assert parsers.rate_payloads(docs).count() == 0 and parsers.ohlc_arrays(docs.withColumn("payload", F.lit("[]"))).count() == 0


def test_trade_tape(spark):
    lines = spark.createDataFrame([("timestamp,symbol,side,size,price",), ("1577836801.5,AF,Buy,2,100.5",), ("1577836804.25,AF,Sell,1,x",)], "line string")
    (r,) = parsers.trade_tape(lines).collect()
    assert (r["sym"], r["side"], r["qty"], r["price"]) == ("AF", "buy", 2.0, 100.5)


def test_close_panel(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 1.0), ("a", 20, 3.0)], "sym string, ts long, c double")
    got = parsers.close_panel(df, step=10).orderBy("ts").collect()
    assert [(r["ts"], r["c"], r["listed"]) for r in got] == [(10, 1.0, True), (20, None, False), (30, 3.0, True)]


def test_ingest_is_idempotent_and_drops_the_future(spark, tmp_path):
    bars = spark.createDataFrame([("A", 1577836800000 + i * 86_400_000, float(i)) for i in range(3)], "sym string, ts long, c double")
    rows = parsers.ohlcv_pit(bars)
    path = str(tmp_path / "pit")
    now = (1577836800000 + 2 * 86_400_000) * 1_000_000
    checks = {"close": F.col("c") >= 0}
    assert ledger.ingest(rows, path, now, checks) == {"rows": 2, "not_known_yet": 1, "partitions": 1}
    assert ledger.ingest(rows, path, now, checks)["partitions"] == 0
    with pytest.raises(store.ContractError):
        ledger.ingest(rows, path, now, {"close": F.col("c") > 0})
    assert [(r["symbol"], r["n"]) for r in ledger.partitions(spark, path, symbol="A").collect()] == [("A", 2)]
    assert ledger.partitions(spark, path, symbol="B").count() == 0
    assert ledger.read_validated(spark, path, rows.schema, ["symbol", "c"], checks).columns == ["symbol", "c"]
    with pytest.raises(store.ContractError):
        ledger.read_validated(spark, path, rows.schema, ["c"], {"c": F.col("c") > 0})


def test_a_slice_is_read_once(spark, tmp_path):
    path = str(tmp_path / "reads")
    df = spark.createDataFrame([("2020-01-01", 1), ("2020-02-01", 2)], "d string, x int").withColumn("d", F.to_date("d"))
    assert [r["x"] for r in ledger.gate_slice(df, "d", "2020-01-15", path, "h1").collect()] == [2]
    with pytest.raises(PermissionError):
        ledger.gate_slice(df, "d", "2020-01-15", path, "h1")
    assert [r["x"] for r in ledger.gate_slice(df, "d", "2020-01-15", path, "h1", before=True).collect()] == [1]
    assert ledger.gate_slice(df, "d", "2020-01-15", path, "h2").count() == 1


def test_ledgers(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), "model string, version int, score double"
    assert ledger.entries(spark, path, schema).count() == 0
    for v in (1, 2):
        ledger.record(spark.createDataFrame([("m", v, 0.1 * v), ("n", v, 0.2)], schema), path)
    assert ledger.entries(spark, path, schema).count() == 4
    assert sorted((r["model"], r["version"]) for r in ledger.latest(ledger.entries(spark, path, schema), ["model"], "version").collect()) == [("m", 2), ("n", 2)]
    ledger.write_meta(spark, path, {"rows": 4})
    assert ledger.read_meta(spark, path) == [{"rows": 4}]


def test_backfill_takes_symbols_from_names(spark, tmp_path):
    for s in ("AF", "RO"):
        spark.createDataFrame([(1.0,)], "c double").coalesce(1).write.parquet(str(tmp_path / f"{s}.parquet"))
    got = ledger.backfill(spark, str(tmp_path / "*.parquet"), "c double").collect()
    assert sorted(r["symbol"] for r in got) == ["AF", "RO"]


def test_prune(spark):
    df = spark.createDataFrame([("2010-01-01",), ("2019-06-01",), ("2020-01-01",)], "d string").withColumn("d", F.to_date("d"))
    assert store.prune(df, "d", 2).count() == 2
