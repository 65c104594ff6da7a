"""The grid runs once per distinct entry; trades get the results that they would have alone."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkbars.operators import features_core, grid
from sparkbars.plans import q_grid
from sparkbars.plans.layout import layout
from sparkbars.sources import fixtures

HOURS, EVENTS = 60, 600


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r, start = random.Random(5), dt.datetime(2024, 1, 2)
    rows = [(i, start + dt.timedelta(minutes=r.randrange(60 * HOURS)), i % 7, "buy", r.uniform(0, 200), f'{{"k": {r.randrange(100)}}}')
            for i in range(EVENTS)]
    rows += [(i, start + dt.timedelta(hours=5 * i), 1, "buy", 50.0, '{"k": 4}') for i in range(3)]  # ids that come twice
    d = str(tmp_path_factory.mktemp("units"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{d}/events.parquet")
    return d


@pytest.fixture(scope="module")
def each(spark, sf_dir):
    """Every trade evaluated by itself."""
    bars, trades = q_grid.entered(spark, sf_dir)
    ent = grid.entries(trades)
    core = grid.with_forward(features_core.compute(layout(grid.mark(bars, ent), indexed=True))).core()
    return grid.evaluate(ent, core, grid.scenarios(spark), carry=("symbol",)).cache()


def _same(got, want):
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_one_evaluation_for_trades_that_enter_alike(spark, sf_dir):
    trades, res = q_grid.grid_results(spark, sf_dir)
    rows = trades.select("uses").distinct().select(F.sum(F.size("uses"))).first()[0]
    assert res.count() == 216 * rows and rows <= 2 * HOURS + 6 < trades.count() == EVENTS


def test_ranks_and_best(spark, sf_dir, each):
    q = q_grid
    _same(q.q_grid_216(spark, sf_dir).drop("rank"), q._grid_select(each))
    ranks = q.q_grid_216(spark, sf_dir).groupBy("trade_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"))
    assert ranks.filter("n <> last").count() == 0 and {r.n for r in ranks.filter("trade_id < 3").collect()} == {432}
    _same(q.q_best_policy(spark, sf_dir).select("trade_id", "pnl_pct"), q._grid_select(grid.best(each.drop("symbol"))).select("trade_id", "pnl_pct"))
    _same(q.q_top_k_scenarios(spark, sf_dir).select("trade_id", "rank", "pnl_pct"),
          q._grid_select(grid.top_k(each, 10), "rank").select("trade_id", "rank", "pnl_pct"))


def test_actual_and_best(spark, sf_dir, each):
    base = q_grid.base_scenario_id()
    want = grid.actual_and_best(each, base, ("symbol",)).select(
        "trade_id", F.col("actual.pnl_pct").alias("a"), F.col("best.pnl_pct").alias("b"))
    _same(q_grid.actual_vs_best(spark, sf_dir).select("trade_id", F.col("actual_pnl").alias("a"), F.col("pnl_pct").alias("b")), want)
    _same(q_grid.q_scenario_eval(spark, sf_dir), q_grid._grid_select(each.filter(F.col("scenario_id") == base)))


def test_weighted_means(spark, each):
    trades = each.groupBy("symbol").agg(F.countDistinct("trade_id")).first()[1]
    alike = each.groupBy("symbol", "entry_idx", *[c for c in each.columns if c not in ("symbol", "entry_idx", "trade_id")]).agg(
        F.count("*").alias("k"))
    assert trades == EVENTS
    _same(grid.best_policy_of(alike, "symbol", weight="k"), grid.best_policy_of(each, "symbol"))


def test_tasks_grow_with_the_units(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(q_grid, "TASK_UNITS", 2)
    ent = q_grid.entry_rows(spark, sf_dir)
    assert ent.tasks == -(-grid.units(ent.trades).count() // 2) > q_grid.parallelism(spark)


def test_no_trades(spark, sf_dir):
    t = fixtures.trades(spark, sf_dir).limit(0).selectExpr("trade_id", "symbol", "side", "0L AS e", "0L AS n")
    assert grid.units(grid.with_uses(t, "trade_id")).count() == 0
