"""Queries that go over whole tables, against brute force."""

import datetime
import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import connect, differ

import __spark_entry__ as entry
from tidemark.sources.tables import BARS_SQL


@pytest.fixture(scope="module")
def closes(sf):
    """sym: its closes in order."""
    found = {}
    for sym, c in connect(sf).execute(f"WITH {BARS_SQL} SELECT sym, c FROM rets ORDER BY sym, i").fetchall():
        found.setdefault(sym, []).append(c)
    return found


def collected(spark, sf, name):
    return sorted(tuple(r) for r in entry.queries()[name](spark, sf).collect())


def test_cusum_goes_on_to_the_end(spark, sf, closes):
    want = []
    for sym, cs in closes.items():
        up = down = 0.0
        for i in range(1, len(cs)):
            x = math.log(cs[i]) - math.log(cs[i - 1])
            up, down = max(0.0, up + x), min(0.0, down + x)
            if up >= 0.1 or down <= -0.1:
                want.append((sym, i + 1, 1 if up >= 0.1 else -1))
                up = down = 0.0
    got = collected(spark, sf, "cusum_events")
    assert got == sorted(want)
    assert all(max(at for s, at, _ in got if s == sym) > 400 for sym in closes)


def spans(closes):
    """Every bar with a return as an event: sym, start, end."""
    return [(sym, i, i + 5 + i % 7) for sym, cs in closes.items() for i in range(2, len(cs) + 1)]


def test_uniqueness_counts_every_bar(spark, sf, closes):
    want = []
    for sym in closes:
        mine = [(a, b) for s, a, b in spans(closes) if s == sym]
        n = {}
        for a, b in mine:
            for t in range(a, b):
                n[t] = n.get(t, 0) + 1
        want += [(sym, a, sum(1 / n[t] for t in range(a, b)) / (b - a)) for a, b in mine]
    got = collected(spark, sf, "average_uniqueness")
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, sorted(want), strict=True))


def test_every_bar_has_a_weight(spark, sf, closes):
    assert [x[:2] for x in collected(spark, sf, "sample_weights")] == sorted(x[:2] for x in spans(closes))


def test_cpcv_tests_every_bar(spark, sf, closes):
    """Each group is in five of the fifteen splits, so each bar is tested five times."""
    n = {}
    for r in entry.queries()["cpcv_membership"](spark, sf).collect():
        n[r["sym"]] = n.get(r["sym"], 0) + r["n_test"]
    assert n == {sym: 5 * (len(cs) - 1) for sym, cs in closes.items()}


def test_walk_forward_goes_on_to_the_end(spark, sf, closes):
    """Every bar from 400 on is in one test fold."""
    want = []
    for sym, cs in closes.items():
        mine = [(a, b) for s, a, b in spans(closes) if s == sym]
        for k in range((len(cs) - 400) // 200 + 1):
            a = 400 + 200 * k
            before = [(x, y) for x, y in mine if a - 400 <= x < a]
            want.append((sym, k, sum(y < a - 10 for _, y in before), sum(a <= x < a + 200 for x, _ in mine), sum(y >= a - 10 for _, y in before)))
    got = collected(spark, sf, "walk_forward_folds")
    assert got == sorted(want)
    assert all(sum(x[3] for x in got if x[0] == sym) == len(cs) - 399 for sym, cs in closes.items())


def test_minimum_variance_weighs_all_symbols(spark, sf, closes):
    """At the least variance all symbols with a weight add the same risk, the others more; moments are those of common days."""
    con = connect(sf)
    moments = con.execute(f"WITH {BARS_SQL} SELECT a.sym, b.sym, covar_samp(a.r, b.r) FROM rets a JOIN rets b USING (d) GROUP BY 1, 2").fetchall()
    w = dict(collected(spark, sf, "minimum_variance"))
    assert sorted(w) == sorted(closes) and len(w) == 6
    assert abs(sum(w.values()) - 1) < 1e-3
    risk = {x: sum(c * w[y] for s, y, c in moments if s == x) for x in w}
    least = sum(risk[x] * w[x] for x in w)
    assert all(abs(risk[x] / least - 1) < 0.01 if w[x] > 0 else risk[x] > 0.99 * least for x in w)


def orders(folder, found):
    """found: key, customer, price, day."""
    key, cust, price, day = zip(*found, strict=True)
    pq.write_table(pa.table({"o_orderkey": pa.array(key, pa.int64()), "o_custkey": pa.array(cust, pa.int64()), "o_totalprice": pa.array(price, pa.float64()), "o_orderdate": pa.array(day, pa.timestamp("us"))}), folder / "orders.parquet")
    return str(folder)


def ranked(spark, sf):
    return differ(spark, connect(sf), entry.queries()["percent_rank_30d"], entry.oracle_sql()["percent_rank_30d"], sf)


def test_ranks_of_odd_orders(spark, tmp_path):
    """Unknown prices and days, ties, NaN, infinite prices, repeated and missing keys, days before 1970, gaps of 29 to 31 days and around the edges of blocks."""
    rng, start = random.Random(5), datetime.datetime(1969, 11, 1)
    days = [0, 1, 29, 30, 31, 58, 59, 60, 61, 62, 91, 92, 119, 120, 121, 200, 230, 261, 400]
    price = lambda: rng.choice([None, float("nan"), float("inf"), 250000.0, 1.0, 2.0, 3.0, rng.uniform(0, 5e5)])
    found = [(rng.choice([None, 7, k]), k % 12, price(), rng.choice([None, *(start + datetime.timedelta(days=d, hours=rng.randrange(24)) for d in days)])) for k in range(900)]
    found += [(5000 + k, 3, None, datetime.datetime(2020, 1, 1)) for k in range(3)]
    assert ranked(spark, orders(tmp_path, found)) is None


def test_ranks_do_not_collect_their_frames(spark, tmp_path):
    """A frame of every row held as a list grows with the square of a day's rows."""
    rng = random.Random(6)
    sf = orders(tmp_path, [(k, 0, float(rng.randrange(100000)), datetime.datetime(2020, 1, 1 + k % 4)) for k in range(8000)])
    plan = entry.queries()["percent_rank_30d"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan
    assert ranked(spark, sf) is None


def test_ranks_without_a_customer(spark, tmp_path):
    """Missing and negative customers belong to the last symbol, as in the SQL."""
    rng = random.Random(7)
    found = [(k, rng.choice([None, -1, -5, -6, 5, 6, 7]), float(rng.randrange(1000)), datetime.datetime(2020, 1, 1 + k % 20)) for k in range(300)]
    assert ranked(spark, orders(tmp_path, found)) is None
