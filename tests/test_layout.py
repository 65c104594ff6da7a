"""Blocks with halo give exactly the results of unsplit symbols."""

import pytest
from pyspark.sql import functions as F

from sparkbars.operators import ema, features_core, features_wide, labels, regime
from sparkbars.params import Params
from sparkbars.plans.layout import index, layout
from sparkbars.sources import fixtures
from tests.conftest import SF_SMALL
from tests.helpers import bars, flat

SMALL = Params(block_rows=64, halo_back=1024, halo_ahead=64)


def _rows(df, cols):
    out = df.select("symbol", "ts", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in cols])
    return sorted(out.collect())


def test_index_is_dense_per_symbol(spark):
    b = index(fixtures.bars_calm(spark, SF_SMALL))
    chk = b.groupBy("symbol").agg(F.min("rn").alias("lo"), F.max("rn").alias("hi"), F.count("*").alias("k"),
                                  F.first("n").alias("n"))
    for r in chk.collect():
        assert r.lo == 0 and r.hi == r.k - 1 == r.n - 1


def test_small_blocks_equal_whole_symbols(spark):
    b = fixtures.bars_calm(spark, SF_SMALL)
    cols = features_core.output_columns() + ["directional_count", "atr_expansion", "realized_return", "macd",
                                             "macd_signal", "rsi_14", "sma_50", "volatility_20"]

    def run(p):
        pan = regime.classify(features_core.compute(layout(b, p), p), p)
        pan = labels.triple_barrier(pan, "long", p)
        pan = ema.macd(pan, "c", p=p)
        wide = features_wide.compute(layout(b, p), p).core().select("symbol", "ts", "rsi_14", "sma_50",
                                                                     "volatility_20")
        return pan.core().join(wide, ["symbol", "ts"])

    big, small = run(Params()), run(SMALL)
    assert small.count() == big.count() == b.count()
    assert _rows(small, cols) == _rows(big, cols)


@pytest.mark.parametrize("span, halo_back", [(1, 10), (1.05, 100), (9, 10), (26, 100), (26, 1024), (200, 10), (200, 1024), (5000, 100)])
def test_blocked_ema_equals_recursion(spark, span, halo_back):
    """Over many blocks, shorter and longer than the halo; old large prices before small ones count."""
    p = Params(block_rows=64, halo_back=halo_back, halo_ahead=5)
    prices = [1e12] * 10 + [1e-3 * (1 + i % 7) for i in range(390)]
    b = bars(spark, [(x, x, x, x, 1) for x in prices]).union(bars(spark, flat(30, 7.0), symbol="Y")).unionByName(
        bars(spark, [(3.0 + i % 11,) * 4 + (1,) for i in range(129)], symbol="Z"))
    pan = ema.ema(layout(b, p), "c", span, "e", p)
    d = ema.decay(span)
    want = {}
    rows = pan.core().collect()
    for s in ("X", "Y", "Z"):
        num = den = 0.0
        for r in sorted((r for r in rows if r.symbol == s), key=lambda r: r.rn):
            num, den = r.c + d * num, 1.0 + d * den
            want[s, r.rn] = num / den
    assert len(want) == 400 + 30 + 129
    for r in pan.df.collect():  # copies in the halo too
        assert abs(want[r.symbol, r.rn] - r.e) <= 1e-9 * abs(want[r.symbol, r.rn]), (r.symbol, r.rn)
