"""Joins between trades and bars.

``nearest_bar`` is an as-of join to the nearest bar in time (ties go to the
earlier bar). It never collects a symbol into one task: trades and bars are
unioned and scanned inside (symbol, time slot) partitions, once forwards and
once backwards with running frames, so the cost of a slot is linear in its
rows; a trade whose nearest neighbour lies in another slot takes it from a
small per-(symbol, slot) carry table (last bar before the slot, first bar
after it), computed with windows over slots and joined back on (symbol, slot).
One shuffle of the union, no cross join, no per-trade candidate lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SLOT_SECONDS = 3600


def _slot(c, seconds: int):
    return F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / F.lit(seconds)).cast("long")


def nearest_bar(bars: DataFrame, trades: DataFrame, t_col: str = "ts_open", key: str = "symbol",
                bar_cols: tuple = ("ts", "rn"), slot: int = SLOT_SECONDS) -> DataFrame:
    """Trades with ``bar_ts``, ``bar_rn`` (and any other ``bar_cols``) of the nearest bar of the same symbol.

    Bars of one time go by ``rn`` if they have it. ``slot`` is the length of a time slot in seconds."""
    turn = F.col("rn") if "rn" in bars.columns else F.lit(0)
    bar = F.struct(*[F.col(c).alias(c) for c in bar_cols])
    trade = F.struct(*[F.col(c).alias(c) for c in trades.columns])
    bar_t = bars.select(bar.alias("_b")).schema["_b"].dataType
    trade_t = trades.select(trade.alias("_tr")).schema["_tr"].dataType
    b = bars.select(key, F.col("ts").alias("_t"), F.lit(0).alias("_kind"), turn.cast("long").alias("_turn"), bar.alias("_bar"),
                    F.lit(None).cast(trade_t).alias("_trade"))
    t = trades.select(key, F.col(t_col).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_turn"),
                      F.lit(None).cast(bar_t).alias("_bar"), trade.alias("_trade"))
    u = b.unionByName(t).withColumn("_d", _slot("_t", slot))
    part = Window.partitionBy(key, "_d")
    onwards = part.orderBy("_t", "_kind", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    # the running frame from the other end; a frame up to the partition's end would be computed again for every row
    back = part.orderBy(F.desc("_t"), F.desc("_kind"), F.desc("_turn")).rowsBetween(Window.unboundedPreceding, 0)
    u = u.select(
        "*",
        F.last("_bar", ignorenulls=True).over(onwards).alias("_prev"),
        F.last("_bar", ignorenulls=True).over(back).alias("_next"),
    ).filter(F.col("_kind") == 1)
    # carry table: per (symbol, slot) the last bar of earlier slots and the first bar of later slots
    at = F.struct("_t", "_turn")
    slots = (
        b.select(key, _slot("_t", slot).alias("_d"), "_bar", "_t", "_turn")
        .groupBy(key, "_d")
        .agg(F.max_by("_bar", at).alias("_last"), F.min_by("_bar", at).alias("_first"))
    )
    tslots = trades.select(key, _slot(t_col, slot).alias("_d")).distinct()
    allk = slots.join(tslots, [key, "_d"], "full")
    earlier, later = (Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_d"), F.desc("_d")))
    carry = allk.select(
        key, "_d",
        F.last("_last", ignorenulls=True).over(earlier).alias("_cprev"),
        F.last("_first", ignorenulls=True).over(later).alias("_cnext"),
    )
    m = u.join(carry, [key, "_d"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_cprev"))
    nxt = F.coalesce(F.col("_next"), F.col("_cnext"))
    tt = F.unix_micros(F.col("_t").cast("timestamp"))
    dp = tt - F.unix_micros(prev["ts"].cast("timestamp"))
    dn = F.unix_micros(nxt["ts"].cast("timestamp")) - tt
    pick = F.when(prev.isNull(), nxt).when(nxt.isNull(), prev).when(dp <= dn, prev).otherwise(nxt)
    return m.select(
        *[F.col("_trade")[c].alias(c) for c in trades.columns],
        *[pick[c].alias(f"bar_{c}") for c in bar_cols],
    )


def entry_window(bars_idx: DataFrame, entries: DataFrame, back: int = 20, ahead: int = 30, at: str = "bar_rn",
                 key: str = "symbol", block: int = 64) -> DataFrame:
    """Every entry with the bars from ``back`` before its bar up to, not including, ``ahead`` after it.

    ``entries`` has ``key`` and ``at``, the row index of its bar; the result has its columns, ``offset`` (bar
    less entry) and the other columns of ``bars_idx``. Windows end with the history; entries without a bar
    have none. Both sides meet on blocks of ``block`` rows, of which an entry reads those its window
    touches, so bars are never copied and a hot symbol is spread over its blocks."""
    first = F.floor(F.greatest(F.col(at) - back, F.lit(0)) / block).cast("long")
    last = F.floor((F.col(at) + (ahead - 1)) / block).cast("long")
    reads = entries.filter(F.col(at).isNotNull()).withColumn("_rows", F.explode(F.sequence(first, last)))
    bars = bars_idx.withColumn("_rows", F.floor(F.col("rn") / block).cast("long"))
    offset = (F.col("rn") - F.col(at)).alias("offset")
    joined = reads.join(bars, [key, "_rows"]).filter((F.col("rn") >= F.col(at) - back) & (F.col("rn") < F.col(at) + ahead))
    return joined.select(*entries.columns, offset, *[c for c in bars_idx.columns if c not in (key, "rn")])


def trade_marks(entries: DataFrame, price: str = "entry_px", target: str = "tp", stop: str = "sl") -> DataFrame:
    """The marks of a trade on its chart: an entry point at the nearest bar, and a target and a stop line where
    the trade has such a price (null and zero: none).

    ``entries``: trade_id, symbol, bar_ts and the three price columns. Trades without a bar have no marks.
    Returns trade_id, symbol, kind ('entry', 'target', 'stop'), ts (of the entry's bar; null for lines), price."""
    no_ts = F.lit(None).cast(entries.schema["bar_ts"].dataType)
    marks = F.array(*[F.struct(F.lit(kind).alias("kind"), ts.alias("ts"), F.col(c).alias("price"))
                      for kind, ts, c in (("entry", F.col("bar_ts"), price), ("target", no_ts, target), ("stop", no_ts, stop))])
    out = entries.filter(F.col("bar_ts").isNotNull()).select("trade_id", "symbol", F.inline(marks))
    return out.filter((F.col("kind") == "entry") | (F.col("price") != 0))
