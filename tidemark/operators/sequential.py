"""Recursions with a reset, one series at a time: one step function serves the batch driver here and the streaming one.

A series is streamed through in order: rows arrive sorted within their partition, and the state of the series at hand is
all that is kept, so neither a long series nor a batch has to fit into memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.functions.shipping import ship


def fold(df: DataFrame, by: str, order: list[str], columns: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], list[tuple]], schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """step(state, row of columns) changes the state and returns output rows; each output row gets the series' key in front."""
    ship(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), start()
        for batch in batches:
            found = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in (by, *columns)), strict=True):
                if k != key:
                    key, state = k, start()
                found += [(k, *x) for x in step(state, tuple(row))]
            if found:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=True)], names)

    used = list(dict.fromkeys([by, *order, *columns]))
    return df.select(*used).repartition(n, by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def cusum_step(threshold: float) -> tuple[Callable[[], dict], Callable]:
    """Symmetric filter on changes of x; both sums restart after an event."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, x = row
        if x is None:
            return []
        change = x - s["last"] if s["last"] is not None else 0.0
        s["last"] = x
        s["up"], s["down"] = max(0.0, s["up"] + change), min(0.0, s["down"] + change)
        if s["up"] >= threshold or s["down"] <= -threshold:
            side = 1 if s["up"] >= threshold else -1
            s["up"] = s["down"] = 0.0
            return [(at, side)]
        return []

    return lambda: {"last": None, "up": 0.0, "down": 0.0}, step


def _opened(s: dict, price: float) -> None:
    s.update(o=price, h=price, l=price, n=0, vol=0.0)


def dollar_step(threshold: float) -> tuple[Callable[[], dict], Callable]:
    """A bar closes when its notional reaches the threshold. The excess rolls over; the closing tick's volume is split in proportion."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, price, qty = row
        if s["n"] is None:
            _opened(s, price)
        s["h"], s["l"], s["n"] = max(s["h"], price), min(s["l"], price), s["n"] + 1
        value = price * qty
        total = s["sum"] + value
        if total < threshold:
            s["sum"], s["vol"] = total, s["vol"] + qty
            return []
        excess = total - threshold
        rest = qty * (excess / value) if value else 0.0
        done = (at, s["o"], s["h"], s["l"], price, s["vol"] + qty - rest, s["n"])
        _opened(s, price)
        s["sum"], s["vol"] = excess, rest
        return [done]

    return lambda: {"n": None, "sum": 0.0}, step


def imbalance_step(threshold: float) -> tuple[Callable[[], dict], Callable]:
    """A bar closes when the signed volume reaches the threshold on either side; what is beyond it stays."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, price, qty, sign = row
        if s["n"] is None:
            _opened(s, price)
        s["h"], s["l"], s["n"], s["vol"] = max(s["h"], price), min(s["l"], price), s["n"] + 1, s["vol"] + qty
        s["sum"] += sign * qty
        if abs(s["sum"]) < threshold:
            return []
        done = (at, s["o"], s["h"], s["l"], price, s["vol"], s["n"])
        rest = s["sum"] - threshold if s["sum"] > 0 else s["sum"] + threshold
        _opened(s, price)
        s["sum"] = rest
        return [done]

    return lambda: {"n": None, "sum": 0.0}, step


def runs_step(threshold: float) -> tuple[Callable[[], dict], Callable]:
    """A bar closes when the volume of one side reaches the threshold; only that side restarts, from its excess."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, price, qty, sign = row
        if s["n"] is None:
            _opened(s, price)
        s["h"], s["l"], s["n"], s["vol"] = max(s["h"], price), min(s["l"], price), s["n"] + 1, s["vol"] + qty
        side = "buys" if sign > 0 else "sells"
        s[side] += qty
        if s[side] < threshold:
            return []
        done = (at, s["o"], s["h"], s["l"], price, s["vol"], s["n"])
        rest = s[side] - threshold
        _opened(s, price)
        s[side] = rest
        return [done]

    return lambda: {"n": None, "buys": 0.0, "sells": 0.0}, step


def kalman_step(process: float, observation: float) -> tuple[Callable[[], dict], Callable]:
    """One-dimensional random-walk filter: (time, level, variance)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, x = row
        if s["x"] is None:
            s["x"], s["p"] = x, observation
        else:
            p = s["p"] + process
            k = p / (p + observation)
            s["x"], s["p"] = s["x"] + k * (x - s["x"]), (1 - k) * p
        return [(at, s["x"], s["p"])]

    return lambda: {"x": None, "p": 0.0}, step


def ledger_step() -> tuple[Callable[[], dict], Callable]:
    """Weighted-average-cost position: (time, quantity, average cost, realised) after each fill of signed quantity."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, price, qty = row
        q = s["q"]
        if q == 0 or (q > 0) == (qty > 0):
            s["cost"] = (s["cost"] * abs(q) + price * abs(qty)) / (abs(q) + abs(qty))
        else:
            closed = min(abs(q), abs(qty))
            s["pnl"] += closed * (price - s["cost"]) * (1 if q > 0 else -1)
            if abs(qty) > abs(q):
                s["cost"] = price
        s["q"] = q + qty
        if s["q"] == 0:
            s["cost"] = 0.0
        return [(at, s["q"], s["cost"], s["pnl"])]

    return lambda: {"q": 0.0, "cost": 0.0, "pnl": 0.0}, step


def breaker_step(trip: float, resume: float) -> tuple[Callable[[], dict], Callable]:
    """Drawdown breaker with hysteresis: (time, drawdown, halted)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, equity = row
        s["peak"] = max(s["peak"], equity)
        drawdown = 1 - equity / s["peak"]
        s["halted"] = drawdown >= trip or (s["halted"] and drawdown > resume)
        return [(at, drawdown, s["halted"])]

    return lambda: {"peak": float("-inf"), "halted": False}, step


def ewm_step(alpha: float, adjust: bool) -> tuple[Callable[[], dict], Callable]:
    """Exponentially weighted mean over all rows so far: (time, mean). A null x changes nothing, but what was known weighs less behind it.

    adjust=False seeds the first value with full weight, and what is known weighs 1 against alpha wherever no gap lies between.
    """

    def step(s: dict, row: tuple) -> list[tuple]:
        at, x = row
        s["weight"] *= 1 - alpha
        if x is not None:
            new = 1.0 if adjust or s["mean"] is None else alpha
            s["mean"] = x if s["mean"] is None else (s["weight"] * s["mean"] + new * x) / (s["weight"] + new)
            s["weight"] = s["weight"] + new if adjust else 1.0
        return [(at, s["mean"])]

    return lambda: {"mean": None, "weight": 0.0}, step


def seeded_variance_step(decay: float, burn_in: int) -> tuple[Callable[[], dict], Callable]:
    """Variance known before the bar: (time, variance). The mean of the first burn_in squares is the seed; from there v = decay * v + (1 - decay) * square."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, x = row
        known = s["v"]
        if x is not None:
            s["n"] += 1
            if s["n"] <= burn_in:
                s["sum"] += x * x
                s["v"] = s["sum"] / burn_in if s["n"] == burn_in else None
            else:
                s["v"] = decay * s["v"] + (1 - decay) * x * x
        return [(at, known)]

    return lambda: {"v": None, "n": 0, "sum": 0.0}, step


def adaptive_step(kind: str) -> tuple[Callable[[], dict], Callable]:
    """Bars whose threshold comes with each row: (time, price, quantity, sign, threshold). kind: dollar, imbalance or runs.

    A null threshold closes nothing. What is beyond the threshold stays for the next bar, as with fixed ones.
    """

    def step(s: dict, row: tuple) -> list[tuple]:
        at, price, qty, sign, threshold = row
        if s["n"] is None:
            _opened(s, price)
        s["h"], s["l"], s["n"], s["vol"] = max(s["h"], price), min(s["l"], price), s["n"] + 1, s["vol"] + qty
        side = "sells" if kind == "runs" and sign < 0 else "sum"
        s[side] += price * qty if kind == "dollar" else qty if kind == "runs" else sign * qty
        if threshold is None or abs(s[side]) < threshold:
            return []
        done = (at, s["o"], s["h"], s["l"], price, s["vol"], s["n"])
        rest = s[side] - threshold if s[side] > 0 else s[side] + threshold
        _opened(s, price)
        s[side] = rest
        return [done]

    return lambda: {"n": None, "sum": 0.0, "sells": 0.0}, step


def break_step(limit: float, least: int) -> tuple[Callable[[], dict], Callable]:
    """Two-sided sums of standardised residuals; a break restarts them, and the next one needs least rows: (time, rows since the last break)."""

    def step(s: dict, row: tuple) -> list[tuple]:
        at, x = row
        s["since"] += 1
        if x is not None:
            s["up"], s["down"] = max(0.0, s["up"] + x), min(0.0, s["down"] + x)
            if (s["up"] > limit or s["down"] < -limit) and s["since"] >= least:
                s["up"] = s["down"] = 0.0
                s["since"] = 0
        return [(at, s["since"])]

    return lambda: {"up": 0.0, "down": 0.0, "since": 10**6}, step


def smoother_step(period: int) -> tuple[Callable[[], dict], Callable]:
    """A two-pole low-pass filter: (time, value)."""
    a = math.exp(-math.sqrt(2) * math.pi / period)
    b = 2 * a * math.cos(math.sqrt(2) * math.pi / period)
    gain = 1 - b + a * a

    def step(s: dict, row: tuple) -> list[tuple]:
        at, x = row
        if s["n"] < 2:
            y = x
        else:
            y = gain * (x + s["x"]) / 2 + b * s["y"] - a * a * s["z"]
        s.update(x=x, z=s["y"], y=y, n=s["n"] + 1)
        return [(at, y)]

    return lambda: {"x": 0.0, "y": 0.0, "z": 0.0, "n": 0}, step
