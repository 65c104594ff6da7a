"""Per-symbol row index and block layout.

Every rolling, lagged or forward-looking bar feature is defined on a symbol's
bars in time order. Partitioning a window by ``symbol`` alone would put a hot
symbol (a third of all rows, say) into one task. Instead:

1. ``index`` numbers each symbol's bars without a window over a whole symbol:
   rows are numbered inside (symbol, day) groups, the per-(symbol, day)
   counts (a small table) are turned into offsets with a window over days,
   and the offsets are joined back on (symbol, day).
2. ``layout`` cuts each symbol into blocks of ``block_rows`` rows by that
   index and copies the last ``halo_back`` rows of the preceding blocks and
   the first ``halo_ahead`` rows of the following blocks next to each block
   ("halo"), so every window partitioned by (symbol, blk) sees the full
   lookback/lookahead of its own ("core") rows. Results of core rows equal
   those of an unsplit window; halo rows are dropped at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..session import shared_dir

DAY_BLOCK = 1  # days per numbering group
#: Bars that a task of ``Panel.spread`` takes, halo copies not counted.
TASK_ROWS = 200_000


def day_block(order: str = "ts", days: int = DAY_BLOCK) -> Column:
    return F.floor(F.unix_date(F.to_date(F.col(order))) / F.lit(days)).cast("long")


def index(bars: DataFrame, key: str = "symbol", order: str = "ts", days: int = DAY_BLOCK, tasks: int | None = None) -> DataFrame:
    """Add ``rn`` (0-based position in the symbol's history) and ``n`` (bars of the symbol).

    ``tasks``: into how many the rows are dealt by (key, days), where their number is known."""
    tb = day_block(order, days)
    b = bars.withColumn("_tb", tb)
    if tasks:
        b = b.repartition(tasks, key, "_tb")
    counts = bars.groupBy(F.col(key), tb.alias("_tb")).agg(F.count(F.lit(1)).alias("_cnt"))
    by_day = Window.partitionBy(key).orderBy("_tb")
    offsets = counts.select(
        key,
        "_tb",
        F.coalesce(F.sum("_cnt").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(key)).alias("n"),
    )
    ties = [c for c in ("o", "h", "l", "c", "v") if c in bars.columns]
    local = Window.partitionBy(key, "_tb").orderBy(order, *ties)  # equal times: an order of their own, the same on every run
    b = b.withColumn("_r", F.row_number().over(local))
    return (
        b.join(offsets, [key, "_tb"])
        .withColumn("rn", (F.col("_off") + F.col("_r") - 1).cast("long"))
        .withColumn("n", F.col("n").cast("long"))
        .drop("_tb", "_r", "_off")
    )


def numbered(bars: DataFrame, key: str = "symbol", order: str = "ts", distinct: bool = False) -> DataFrame:
    """``index`` where every history fits a task: the same ``rn`` and ``n`` from windows over whole histories. Bars go
    through one exchange by ``key``, or none where they are dealt by it, and are read once.

    ``distinct``: no two bars of a history have one time, so bars in order of time are not sorted again."""
    ties = [] if distinct else [c for c in ("o", "h", "l", "c", "v") if c in bars.columns]
    own = Window.partitionBy(key)
    b = bars.filter(F.col(key).isNotNull()).select(
        "*", F.count(F.lit(1)).over(own).cast("long").alias("n"), (F.row_number().over(own.orderBy(order, *ties)) - 1).cast("long").alias("rn"))
    return b.filter(F.col(order).isNotNull())  # bars without a time count, as in ``index``, and come first


@dataclass
class Panel:
    """Bars laid out in (symbol, blk) partitions with halo rows (``core`` = false).

    ``longest``: runs a count and gives the bars of the longest history (or a known bound of them). ``total``: from the same count, all bars."""

    df: DataFrame
    key: str = "symbol"
    order: str = "ts"
    params: Params = DEFAULT
    longest: Callable[[], int] | None = None
    total: Callable[[], int] | None = None

    @property
    def w(self) -> Window:
        return Window.partitionBy(self.key, "blk").orderBy(self.order)

    def with_df(self, df: DataFrame) -> "Panel":
        return Panel(df, self.key, self.order, self.params, self.longest, self.total)

    def spread(self, task_rows: int = TASK_ROWS) -> "Panel":
        """The same rows dealt by (symbol, blk) into tasks of about ``task_rows``, counted: where a stage sorts its rows
        several times, the memory of a task stays the same however many bars there are (a block is never split)."""
        if self.total is None:
            return self
        tasks = max(self.df.sparkSession.sparkContext.defaultParallelism, -(-self.total() // task_rows))
        return self.with_df(self.df.repartition(tasks, self.key, "blk"))

    def core(self) -> DataFrame:
        """The bars themselves: halo copies dropped, layout columns removed."""
        return self.df.filter(F.col("core")).drop("blk", "core")

    def filled(self, cols: list[str], where: Column | None = None) -> DataFrame:
        """``df`` with nulls of ``cols`` (in rows ``where`` that holds) filled with the last value before
        them, however far back.

        Inside a partition a running frame finds it. If some history has more than one block, ``df`` is
        written once to the shared folder, and what lies before the halo comes from a carry table of it, one
        row per block: the last value of each column in the core rows, taken on from block to block."""
        where = F.lit(True) if where is None else where
        upto = self.w.rowsBetween(Window.unboundedPreceding, 0)
        one_block = self.longest is not None and self.longest() <= self.params.block_rows
        df = self.df
        if not one_block:
            shared_dir(df.sparkSession)
            df = df.checkpoint(eager=True)
        here = df.select(*[F.when(where, F.last(F.col(c), ignorenulls=True).over(upto)).otherwise(F.col(c)).alias(c) if c in cols
                           else F.col(c) for c in df.columns])
        if one_block:
            return here
        earlier = Window.partitionBy(self.key).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        last = df.filter("core").groupBy(self.key, "blk").agg(
            *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("rn"))).alias(c) for c in cols])
        carry = last.select(self.key, "blk", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in cols])
        joined = here.join(carry, [self.key, "blk"], "left")
        return joined.select(*[F.when(where, F.coalesce(F.col(c), F.col(f"_carry_{c}"))).otherwise(F.col(c)).alias(c) if c in cols
                               else F.col(c) for c in df.columns])

    def part_start(self):
        """Index (rn) of the first row, halo included, of this row's partition."""
        p = self.params
        return F.greatest(F.col("blk") * F.lit(p.block_rows) - F.lit(p.halo_back), F.lit(0))


def layout(bars: DataFrame, params: Params = DEFAULT, key: str = "symbol", order: str = "ts",
           indexed: bool = False, most: int | None = None, distinct: bool = False) -> Panel:
    """Index the bars (unless ``indexed``) and lay them out in blocks with halo.

    ``most``: bars that no history exceeds, if that is known. Where a block has room for them every history is one block,
    numbered where its bars lie (``numbered``), and there is no halo. ``distinct``: no two bars of a history have one time;
    whole histories then stay sorted by it."""
    p = params
    whole = not indexed and most is not None and most <= p.block_rows
    df = bars if indexed else numbered(bars, key, order, distinct) if whole else index(bars, key, order)
    B = F.lit(p.block_rows)
    rn, n = F.col("rn"), F.col("n")
    first = F.greatest(F.floor((rn - F.lit(p.halo_ahead)) / B), F.lit(0)).cast("long")
    last = F.least(F.floor((rn + F.lit(p.halo_back)) / B), F.floor((n - 1) / B)).cast("long")
    own = F.floor(rn / B).cast("long")
    if whole:
        df = df.select("*", F.lit(0).cast("long").alias("blk"), F.lit(True).alias("core"))
    else:
        df = df.withColumn("blk", F.explode(F.sequence(first, last))).withColumn("core", F.col("blk") == own)

    @cache
    def counts() -> tuple[int, int]:
        sizes = bars.agg(F.max("n"), F.count(F.lit(1))) if indexed else bars.groupBy(key).count().agg(F.max("count"), F.sum("count"))
        most, rows = sizes.first()
        return most or 0, rows or 0

    return Panel(df, key, order if whole and distinct else "rn", p, lambda: most if whole else counts()[0], lambda: counts()[1])
