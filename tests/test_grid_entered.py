"""Paths of entered bars alone: same results as paths of every bar, nothing built for the others."""

import random

from pyspark.sql import functions as F

from sparkbars.operators import features_core, grid
from sparkbars.plans.layout import index, layout
from tests.helpers import bars


def _table(spark, n=160):
    r = random.Random(3)
    rows, c = [], 100.0
    for _ in range(n):
        o, c = c, c * (1 + r.uniform(-0.01, 0.01))
        rows.append((o, max(o, c) * 1.002, min(o, c) * 0.998, c, r.randint(1, 9)))
    return index(bars(spark, rows)).cache()


def test_marked_bars_give_the_same_grid(spark):
    b = _table(spark)
    held = [(1, "long", 0), (2, "short", 0), (3, "long", 40), (4, "long", 40), (5, "short", 41), (6, "short", 158), (7, "long", 159)]
    t = spark.createDataFrame([(i, "X", side, e, 160) for i, side, e in held], "trade_id long, symbol string, side string, e long, n long")
    ent = grid.entries(t)
    every = grid.with_forward(features_core.compute(layout(b, indexed=True))).core()
    marked = grid.with_forward(features_core.compute(layout(grid.mark(b, ent), indexed=True))).core()
    used = {(r.entry_idx, r.side) for r in ent.select("entry_idx", "side").collect()}
    assert {(r.entry_idx, r.side) for r in grid.exit_table(marked).select("entry_idx", "side").collect()} == used
    assert marked.count() == len({i for i, _ in used}) < every.count() == 160
    full, some = (grid.evaluate(ent, core, grid.scenarios(spark)) for core in (every, marked))
    assert full.count() == 216 * len(held)
    assert full.exceptAll(some).count() == 0 and some.exceptAll(full).count() == 0


def test_no_entries(spark):
    b = _table(spark)
    none = spark.createDataFrame([], "trade_id long, symbol string, side string, e long, n long")
    ent = grid.entries(none)
    core = grid.with_forward(features_core.compute(layout(grid.mark(b, ent), indexed=True))).core()
    assert core.count() == 0
    assert grid.evaluate(ent, core, grid.scenarios(spark)).count() == 0
    assert grid.mark(b, ent).filter(F.col("enter_long") | F.col("enter_short")).count() == 0
