"""Streaming twins: tumbling bars with a watermark, dedup, sessions, last quotes, and recursions with keyed state."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.shipping import ship


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Ticks from a folder of event files; the schema is given, never inferred."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return e.select(F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), (1 + F.col("user_id") % 10).cast("double").alias("qty"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"))


def tumbling_bars(t: DataFrame, size: str, late: str) -> DataFrame:
    """Bars that are final once the watermark has passed their end; the state is one row for each open bar."""
    order = F.struct("ts", "seq")
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0.0))
    g = t.withWatermark("ts", late).groupBy("sym", F.window("ts", size).alias("w"))
    return g.agg(F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.sum("qty").alias("vol"), F.count("*").alias("n"), side("buy").alias("buy"), side("sell").alias("sell")).select("sym", F.col("w.start").alias("ts"), "o", "h", "l", "c", "vol", "n", "buy", "sell")


def deduplicated(t: DataFrame, late: str) -> DataFrame:
    """Each event id once; ids older than the watermark leave the state."""
    return t.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"])


def sessions(t: DataFrame, gap: str, late: str, by: str = "sym") -> DataFrame:
    return t.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_quotes(t: DataFrame) -> DataFrame:
    """The last price of each series so far; for update or complete mode."""
    return t.groupBy("sym").agg(F.max_by("price", F.struct("ts", "seq")).alias("price"), F.max("ts").alias("ts"), F.count("*").alias("n"))


def stateful(t: DataFrame, by: str, order: list[str], columns: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], list[tuple]], schema: str, state_schema: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The step functions of the batch operators over a stream, in the order of event time.

    Rows wait in the state until the watermark (the latest time seen less late) has passed them, and are stepped through then, in
    order; so files or micro-batches that arrive out of order give the same results. Rows behind the watermark are dropped, as in
    any watermarked aggregation. The state is the recursion's own and the rows of the last period of late.
    """
    names = [c.split()[0] for c in state_schema.split(", ")]
    out_names = [c.split()[0] for c in schema.split(", ")]
    used = list(dict.fromkeys([time, *order, *columns]))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = start(), []
        if state.exists:
            *values, kept = state.get
            held, waiting = dict(zip(names, values, strict=True)), [pickle.loads(kept)]
        rows = pd.concat([*waiting, *(f[used] for f in frames if len(f))]) if waiting or not state.hasTimedOut else pd.DataFrame(columns=used)
        mark = state.getCurrentWatermarkMs()
        ripe = rows[time].astype("datetime64[us]").astype("int64") // 1000 < mark
        now, later = rows[ripe].sort_values(order), rows[~ripe]
        out = [(key[0], *x) for row in now[columns].itertuples(index=False, name=None) for x in step(held, row)]
        state.update((*(held.get(n) for n in names), pickle.dumps(later)))
        if len(later):
            first = int(later[time].astype("datetime64[us]").astype("int64").min() // 1000)
            state.setTimeoutTimestamp(max(first, mark) + 1)
        yield pd.DataFrame(out, columns=out_names)

    ship(t.sparkSession)
    return t.withWatermark(time, late).groupBy(by).applyInPandasWithState(run, schema, f"{state_schema}, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def once(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch goes to a folder of its own, so that a batch that runs again replaces itself: every row is settled exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def routed(routes: dict[str, Callable[[list], None]], kind: str = "kind", at_once: int = 1000) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: alerts go to the route of their kind, at most at_once of them with the number of all."""

    def send(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, route in routes.items():
            mine = batch.where(F.col(kind) == name)
            if n := mine.count():
                route([{"batch": number, "total": n}, *(r.asDict() for r in mine.limit(at_once).collect())])
        batch.unpersist()

    return send


class Metrics(StreamingQueryListener):
    """Rows, durations and state of every micro-batch, kept as the last so many records."""

    def __init__(self, keep: int = 1000):
        self.records: deque = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:  # noqa: N802  the listener's own names
        self.records.append({"started": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.records.append({"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "ms": dict(p.durationMs), "state": [s.numRowsTotal for s in p.stateOperators]})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.records.append({"ended": str(event.id)})
