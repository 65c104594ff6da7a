"""Exponential moving average without a sequential loop.

ewm_mean with adjust=True (weights (1-a)^i, a = 2/(span+1), min_periods=1):

    y_t = num_t / den_t,  num_t = sum_{j<=t} d^(t-j) x_j,  den_t = (1 - d^(t+1)) / (1 - d),  d = 1 - a

``num`` is an affine scan, and nothing of it is left out. Inside each
(symbol, blk) partition the rows are cut into sub-blocks; within one,
num = d^i * running_sum(x * d^-i) (i = position in the sub-block, as many rows
as keep d^-i below 1e200). Earlier sub-blocks contribute their end totals, read
with RANGE frames over the sub-block number and scaled by d^(distance), back to
where that power is zero in a double.

What lies before a partition comes from a state table, one row per block: the
weighted sum of its core rows, combined over the blocks before it by an
associative scan (each step adds what lies 1, 2, 4, ... blocks back times the
decay of that distance). It is made only where some history has more than one
block, and joined on the partitioning of the layout.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..plans.layout import Panel

#: Largest power d^-i within a sub-block, as a natural logarithm: 1e200 leaves prices room to 1e108.
REACH = 200 * math.log(10)


def decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def scan_rows(span: float) -> int:
    """Rows of a sub-block."""
    return max(1, int(REACH / -math.log(decay(span))))


def states(panel: Panel, x: str, span: float, out: str) -> DataFrame:
    """(key, blk) -> ``out``: num of the row before the partition's first row (halo included), 0 if there is none."""
    p, d = panel.params, decay(span)
    blocks, rest = divmod(p.halo_back, p.block_rows)  # the partition starts ``rest`` rows before the end of a block
    i = F.col("rn") - F.col("blk") * F.lit(p.block_rows)
    xi = F.col(x).cast("double")

    def upto(end: int):
        """Weighted sum of the block's first ``end`` rows, seen from the last of them."""
        return F.sum(F.when(i < end, xi * F.pow(F.lit(d), F.lit(end - 1) - i)))

    sums = panel.df.filter("core").groupBy(panel.key, "blk").agg(
        upto(p.block_rows).alias("_whole"), upto(p.block_rows - rest).alias("_part"))
    w = Window.partitionBy(panel.key).orderBy("blk")
    step = 1
    while d ** (p.block_rows * step) > 0.0:
        before = F.coalesce(F.lag("_whole", step).over(w), F.lit(0.0))
        sums = sums.withColumn("_whole", F.col("_whole") + F.lit(d ** (p.block_rows * step)) * before)
        step *= 2
    part = F.lag("_part", blocks + 1).over(w)
    whole = F.lag("_whole", blocks + 2).over(w)
    carry = F.coalesce(part, F.lit(0.0)) + F.lit(d ** (p.block_rows - rest)) * F.coalesce(whole, F.lit(0.0))
    return sums.select(panel.key, "blk", carry.alias(out))


def ema(panel: Panel, x: str, span: float, out: str, p: Params = DEFAULT, rows: int | None = None) -> Panel:
    """Append column ``out`` = EMA of ``x`` (x must have no nulls) for any span of 1 and more.

    ``rows``: length of the sub-blocks, where several averages are to share one (at most that of each)."""
    d = decay(span)
    if d == 0.0:
        return panel.with_df(panel.df.withColumn(out, F.col(x).cast("double")))
    S = min(rows or scan_rows(span), scan_rows(span))
    q = F.col("rn") - panel.part_start()
    df = panel.df
    one_block = panel.longest is not None and panel.longest() <= panel.params.block_rows
    if not one_block:
        df = df.join(states(panel, x, span, "_state"), [panel.key, "blk"], "left")
    df = df.withColumn("_sb", F.floor(q / S).cast("long")).withColumn("_i", (q % S).cast("int"))
    dl = F.lit(d)
    xi = F.col(x).cast("double")
    in_sb = Window.partitionBy(panel.key, "blk", "_sb").orderBy(panel.order).rowsBetween(
        Window.unboundedPreceding, 0)
    num = F.pow(dl, F.col("_i")) * F.sum(xi * F.pow(dl, -F.col("_i"))).over(in_sb)
    most = panel.params.block_rows + panel.params.halo_back + panel.params.halo_ahead
    by_sb = Window.partitionBy(panel.key, "blk").orderBy("_sb")
    z = xi * F.pow(dl, F.lit(S - 1) - F.col("_i"))
    k, carry = 1, None
    while k * S < most and d ** (S * (k - 1)) > 0.0:
        term = F.lit(d ** (S * (k - 1))) * F.coalesce(F.sum(z).over(by_sb.rangeBetween(-k, -k)), F.lit(0.0))
        carry = term if carry is None else carry + term
        k += 1
    if carry is not None:
        num = num + F.pow(dl, F.col("_i") + 1) * carry
    if not one_block:
        num = num + F.pow(dl, q + 1) * F.col("_state")
    den = (F.lit(1.0) - F.pow(dl, F.col("rn") + 1)) / F.lit(1.0 - d)
    return panel.with_df(df.withColumn(out, num / den).drop("_state", "_sb", "_i"))


def macd(panel: Panel, price: str = "c", fast: int = 12, slow: int = 26, signal: int = 9,
         p: Params = DEFAULT) -> Panel:
    """macd = EMA_fast - EMA_slow, macd_signal = EMA_signal(macd), macd_histogram = difference."""
    rows = min(scan_rows(s) for s in (fast, slow, signal) if decay(s) > 0)  # one sort for all three
    pan = ema(panel, price, fast, "_ema_fast", p, rows)
    pan = ema(pan, price, slow, "_ema_slow", p, rows)
    pan = pan.with_df(pan.df.withColumn("macd", F.col("_ema_fast") - F.col("_ema_slow")))
    pan = ema(pan, "macd", signal, "macd_signal", p, rows)
    df = pan.df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_ema_fast", "_ema_slow")
    return pan.with_df(df)
