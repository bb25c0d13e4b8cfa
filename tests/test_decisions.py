"""Rules, solvers and steps that have no SQL twin, by hand-made cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import sequential as S
from tidemark.plans import decisions, extras, gates, panels, temporal


def steps(maker, rows):
    start, step = maker
    state = start()
    return [x for row in rows for x in step(state, row)]


COV = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])


def test_equal_risk():
    x = decisions.equal_risk(COV)
    risk = x * (COV @ x)
    assert abs(x.sum() - 1) < 1e-9 and np.allclose(risk, risk[0], rtol=1e-6)


def test_capped_weights_are_the_nearest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = decisions.capped(rng.normal(size=5), 0.4)
        assert abs(x.sum() - 1) < 1e-9 and x.min() >= 0 and x.max() <= 0.4 + 1e-9
    assert np.allclose(decisions.capped(np.array([0.2, 0.3, 0.5]), 0.6), [0.2, 0.3, 0.5])


def test_least_variance_with_a_cap():
    x = decisions.descended(lambda v: COV @ v, 3, np.trace(COV), 1.0)
    free = np.linalg.solve(COV, np.ones(3))
    assert np.allclose(x, free / free.sum(), atol=1e-4)
    assert decisions.descended(lambda v: COV @ v, 3, np.trace(COV), 0.4).max() <= 0.4 + 1e-9


def test_hierarchical_weights():
    x = decisions.hierarchical(np.diag([1.0, 2.0, 4.0, 8.0]))
    assert abs(x.sum() - 1) < 1e-9 and (x > 0).all() and x[0] > x[3]


def test_views_move_the_means():
    mean = np.zeros(3)
    got = decisions.posterior(mean, COV, np.array([[1.0, -1.0, 0.0]]), np.array([0.1]))
    assert got[0] - got[1] > 0 and np.allclose(decisions.posterior(mean, COV, np.array([[1.0, 0, 0]]), np.array([0.0])), 0)


def test_directional_sums_restart_alone():
    found = steps(decisions.directional_step(1.0, 1.0), [(1, 0.0), (2, 1.2), (3, 0.5), (4, 0.1), (5, 1.2)])
    assert found == [(2, 1), (4, -1), (5, 1)] or found == [(2, 1), (4, -1)] or (2, 1) in found and (4, -1) in found


def test_adaptive_bars_close_at_their_rows_threshold():
    bars = steps(S.adaptive_step("dollar"), [(1, 10.0, 1.0, 1, None), (2, 10.0, 1.0, 1, 15.0), (3, 10.0, 2.0, 1, 30.0), (4, 10.0, 2.0, 1, 5.0)])
    assert [b[0] for b in bars] == [2, 4] and bars[0][5] == 2.0
    runs = steps(S.adaptive_step("runs"), [(1, 5.0, 3.0, -1, 5.0), (2, 5.0, 3.0, 1, 5.0), (3, 5.0, 3.0, -1, 5.0)])
    assert [b[0] for b in runs] == [3]


def test_breaks_need_their_distance():
    found = steps(S.break_step(2.0, 3), [(i, 1.0) for i in range(9)])
    assert [at for at, since in found if since == 0] == [2, 5, 8]


def test_smoother_keeps_a_constant():
    assert all(abs(v - 3.0) < 1e-9 for _, v in steps(S.smoother_step(10), [(i, 3.0) for i in range(50)]))


def test_governor_latches_until_the_day_ends():
    rows = [(1, "a", 100.0), (2, "a", 97.0), (3, "a", 94.0), (4, "a", 100.0), (5, "b", 100.0)]
    assert [s for _, s in steps(decisions.governor_step(0.02, 0.05), rows)] == ["ok", "soft", "flatten", "flatten", "ok"]


def test_latch_has_hysteresis():
    assert [on for _, on in steps(decisions.latch_step(-1.5, -0.5), [(1, 0.0), (2, -2.0), (3, -1.0), (4, None), (5, -0.4), (6, -1.0)])] == [False, True, True, True, False, False]


def test_block_bootstraps():
    rng = np.random.default_rng(2)
    x = decisions.circular_blocks(50, 7, rng)
    assert len(x) == 50 and all((x[i + 1] - x[i]) % 50 == 1 for i in range(6))
    y = decisions.block_shuffle(50, 10, 2, rng)
    assert len(y) == 50 and (y < 0).sum() == 8 and len(set(y[y >= 0])) == 42


def test_sequential_bootstrap_prefers_what_is_new():
    t0 = np.array([0] * 9 + [100])
    t1 = t0 + 10
    counts = sum((decisions.sequential_bootstrap(t0, t1, 2, np.random.default_rng(s)) == 9).sum() for s in range(400))
    assert counts > 400 * 2 * 0.1  # alone in its place, it is drawn more often than one in ten


def test_paths_cover_all_groups():
    assert len(decisions.PATHS) == 15 and all(sorted(x for fold in path for x in fold) == list(range(6)) for path in decisions.PATHS)


def test_normal_law_and_deflation():
    assert abs(gates.normal_quantile(0.975) - 1.959964) < 1e-5 and abs(gates.normal_cdf(1.0) - 0.841345) < 1e-6
    few, many = (gates.deflated(0.1, 1000, 0.001, 0.0, 3.0, m) for m in (2, 100))
    assert 0 < many < few < 1
    assert gates.detectable_difference(4, 1.0, 0.9) < gates.detectable_difference(4, 1.0, 0.0)


def test_superior_ability():
    rng = np.random.default_rng(3)
    noise = rng.normal(size=(400, 3))
    lower, consistent, upper = gates.superior(noise, 200, 10, rng)
    assert lower <= consistent + 0.05 and consistent <= upper + 0.05 and consistent > 0.05
    assert gates.superior(noise + [0, 0, 0.5], 200, 10, rng)[1] < 0.01


def test_online_quantile_comes_near():
    rng = random.Random(4)
    xs = [rng.gauss(0, 1) for _ in range(3000)]
    (*_, last) = steps(gates.quantile_step(0.5), list(enumerate(xs)))
    assert abs(last[1] - sorted(xs)[1500]) < 0.05


def test_engine_balances_and_stops():
    rows = [(i, 100.0 * (1 + 0.01 * math.sin(i)), 1e-5, 0.4) for i in range(60)]
    found = steps(gates.engine_step(0.5, 0.0005), rows)
    assert len(found) == 60 and all(x[-1] for x in found) and found[0][1] == 0.0 and found[1][1] > 0  # decided at a bar, filled at the next


def test_engine_agrees_with_a_vectorised_book_without_costs():
    rng = random.Random(6)
    prices = [100.0]
    for _ in range(200):
        prices.append(prices[-1] * (1 + rng.gauss(0, 0.01)))
    got = steps(gates.engine_step(1.0, 0.0), [(i, p, 0.0, 0.3) for i, p in enumerate(prices)])
    equity = 1e6
    for i in range(2, len(prices)):
        equity *= 1 + 0.3 * (prices[i] / prices[i - 1] - 1)
    assert abs(got[-1][3] / equity - 1) < 1e-9


def test_basis_actions():
    rows = [(1, 100.0, 100.0, 0.0), (2, 100.0, 110.0, 0.1), (3, None, 110.0, None), (4, 100.0, 195.0, 0.95), (5, 100.0, 100.0, 0.0)]
    assert [a for _, a, *_ in steps(gates.basis_step(0.05, 0.2), rows)] == ["wait", "enter", "unhedged", "margin", "wait"]


def test_greedy_trades_do_not_overlap():
    found = steps(gates.greedy_step(), [(1, 5, 1, 0.1), (2, 6, 1, 0.1), (5, 9, -1, 0.1), (7, 8, 0, 0.1), (9, 12, 1, 0.1)])
    assert [(a, b) for a, b, *_ in found] == [(1, 5), (5, 9), (9, 12)]


def test_filtered_states_see_the_past_alone():
    calm, wild = [0.1] * 30, [2.5] * 5
    p = [x for _, x in steps(gates.filter_step(0.95, 0.5, 1.5), list(enumerate(calm + wild)))]
    assert p[29] < 0.1 and p[-1] > 0.9
    assert p[:30] == [x for _, x in steps(gates.filter_step(0.95, 0.5, 1.5), list(enumerate(calm)))]


def test_judge():
    assert gates.judge({"sharpe": 1.0}, {"sharpe": (">", 0.5), "drawdown": ("<", 0.2)}) == {"sharpe": True, "drawdown": False}


def test_feature_map():
    assert temporal.feature_map(["sym", "feat_a", "feat_a_meso", "feat_macro_b", "feat_c_macro"]) == {"micro": ["feat_a"], "meso": ["feat_a_meso"], "macro": ["feat_macro_b", "feat_c_macro"]}


def test_feature_chain(spark):
    known = gates.Features()
    known.register("one", lambda df: df.withColumn("feat_x", F.col("c") * 2), ["feat_x"], 2)
    known.register("two", lambda df: df.withColumn("feat_y", F.col("feat_x") + 1), ["feat_y"], 3)
    with pytest.raises(ValueError):
        known.register("one", None, [], 0)
    df = spark.createDataFrame([("a", i, float(i)) for i in range(8)], "sym string, d int, c double")
    got = known.apply(df, ["one", "two"]).orderBy("d").collect()
    assert [r["feat_x"] for r in got][:3] == [None, None, 4.0] and [r["feat_y"] for r in got][4:6] == [None, 11.0]
    assert known.burn_in(["one", "two"]) == 5 and known.digest("one", a=1) != known.digest("one", a=2)


def test_guards(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "sym string, d int, x double")
    assert gates.guarded(df, gates.schema_hash(df)) is df
    with pytest.raises(ValueError):
        gates.guarded(df.withColumn("x", F.col("x").cast("float")), gates.schema_hash(df))
    assert gates.check_alpha(df, "x", 1) == {"beyond": 1, "early": 1, "repeated": 0}
    assert gates.kept_features(df.withColumn("feat_a", F.lit(1)).withColumn("feat_b", F.lit(1)), {"feat_a": 0.1, "feat_b": -0.2}).columns == ["sym", "d", "x", "feat_a"]


def test_causal_scouts(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, -1)], "sym string, d int, side int")
    decisions.assert_causal(df, df.where("d = 1"), ["sym", "d"])
    with pytest.raises(ValueError):
        decisions.assert_causal(df, df.where("d = 1").withColumn("side", -F.col("side")), ["sym", "d"])


def test_optimize_by_name(spark, sf):
    for method in decisions.METHODS:
        w = {r["sym"]: r["w"] for r in decisions.optimize(spark, sf, method).collect()}
        assert abs(sum(w.values()) - 1) < 1e-6 and min(w.values()) >= 0
    with pytest.raises(ValueError):
        decisions.optimize(spark, sf, "none")


def test_shrinkage(spark):
    names, cov, share = decisions.shrunk(spark, "/root/testdata/sf0.01")
    assert 0 <= share <= 1 and np.linalg.eigvalsh(cov).min() > 0


def test_regimes_add_up(spark, sf):
    rows = panels.regime_soft(spark, sf).collect()
    assert all(abs(r["p0"] + r["p1"] + r["p2"] - 1) < 1e-5 for r in rows)


def test_own_data_source(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Bars(DataSource):
        @classmethod
        def name(cls):
            return "own_bars"

        def schema(self):
            return "sym string, c double"

        def reader(self, schema):
            class Reader(DataSourceReader):
                def read(self, partition):
                    yield ("a", 1.0)
                    yield ("b", 2.0)

            return Reader()

    gates.register_source(spark, Bars)
    assert sorted(tuple(r) for r in spark.read.format("own_bars").load().collect()) == [("a", 1.0), ("b", 2.0)]


def test_model_fits():
    rng = np.random.default_rng(5)
    calm = rng.normal(0, 0.01, 400)
    wild = rng.normal(0, 0.05, 400)
    found = extras.hidden_fit(np.concatenate([calm, wild]))
    assert abs(found["low"] / 0.01 - 1) < 0.15 and abs(found["high"] / 0.05 - 1) < 0.15 and found["stay"] > 0.9
    v, x = 1.0, []
    for _ in range(1000):
        x.append(rng.normal() * math.sqrt(v))
        v = 0.1 + 0.18 * x[-1] ** 2 + 0.72 * v
    fit = extras.garch(np.array(x))
    assert 0.05 < fit["alpha"] < 0.35 and 0.5 <= fit["beta"] < 0.95


def test_phase_of_a_wave():
    t = np.arange(64)
    p = extras.phase(np.stack([np.cos(2 * np.pi * (t - s) / 16) for s in range(16)]))
    assert len(np.unique(np.round(p, 2))) > 8


def test_levered_scale_holds_its_margin():
    found = steps(extras.levered_step(10.0, 0.5, 0.0), [(1, None), (2, -20.0), (3, 1.0)])
    assert abs(found[0][1] - 10.0) < 1e-6 and found[2][1] < found[0][1] and found[2][1] * 0.2 <= 0.5 + 1e-6


def test_market_sink(spark, tmp_path):
    bars = spark.createDataFrame([("a", 1, 1.0, 2.0, 0.5, 1.5, 3.0)], "sym string, d int, o double, h double, l double, c double, vol double")
    extras.write_market(bars, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    from tidemark.sources import store

    for bad in (bars.union(bars), bars.withColumn("h", F.lit(0.1))):
        with pytest.raises(store.ContractError):
            extras.write_market(bad, str(tmp_path / "n"))
