"""Bars, trades and scored rows derived from the test tables by Spark jobs.

The test tables hold no price bars, so bars are built from them with
aggregates (see FIXTURES.md): ``bars_panel`` from ``lineitem`` (one symbol per
supplier, daily), ``bars_hour``/``bars_calm`` from ``events`` (one symbol per
event type, hourly), ``bars_user`` (one bar per event, per user). ``trades``
are the events themselves: every event is a trade entered at its time on the
calm price of its event type. All outputs use the canonical bar schema
``symbol, ts, o, h, l, c, v, vwap, base_score``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import ieee_div

BAR_COLS = ["symbol", "ts", "o", "h", "l", "c", "v", "vwap", "base_score"]

#: Rows of a symbol that one task takes at most, and rows of a task that takes several symbols.
HISTORY_ROWS, TASK_ROWS = 65_536, 200_000

# Fixed value: the pattern of the integer in the events' props text, {"k": <int>}.
K_PATTERN = r'"k":\s*(-?\d+)'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def props_k(c="props"):
    return F.regexp_extract(F.col(c), K_PATTERN, 1).try_cast("int")


def _with_vwap(df: DataFrame) -> DataFrame:
    return df.withColumn("vwap", (F.col("h") + F.col("l") + F.col("c")) / F.lit(3.0)).select(*BAR_COLS)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem with what bars_panel needs of them."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.col("l_shipdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount")


def _daily(lines: DataFrame) -> DataFrame:
    p = F.lit(1000.0) + F.least(ieee_div("l_extendedprice", "l_quantity"), F.lit(5000.0)) / F.lit(100.0)
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    bars = (
        lines.select("symbol", "ts", p.alias("p"), order.alias("k"), "l_quantity", "l_discount")
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("p", "k").alias("o"),
            F.max("p").alias("h"),
            F.min("p").alias("l"),
            F.max_by("p", "k").alias("c"),
            F.sum("l_quantity").cast("long").alias("v"),
            (F.max("l_discount") * F.lit(10.0)).alias("base_score"),
        )
    )
    return _with_vwap(bars)


def bars_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier from lineitem (the main, many-symbol fixture)."""
    return _daily(_lines(spark, sf_dir))


def panel_histories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """``bars_panel``, and a number of bars that no symbol exceeds (counted: its rows, or its bars if it has many rows).

    Where every symbol has few rows, the rows themselves, narrower than the sums they make, are dealt by symbol, into
    tasks of TASK_ROWS counted rows, and no later step by symbol moves their bars. Otherwise bars are as in ``bars_panel``,
    so the rows of a hot symbol are summed before they meet."""
    lines = _lines(spark, sf_dir)
    known = lines.filter("symbol IS NOT NULL")
    most, rows = known.groupBy("symbol").count().agg(F.max("count"), F.sum("count")).first()
    if (most or 0) > HISTORY_ROWS:
        bars = _daily(lines)
        return bars, bars.filter("symbol IS NOT NULL").groupBy("symbol").count().agg(F.max("count")).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-(rows or 0) // TASK_ROWS))
    return _daily(known.repartition(tasks, "symbol")), most or 0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", props_k().alias("k")
    )


def calm_price(value="value"):
    return F.lit(1000.0) + F.least(F.col(value), F.lit(200.0)) / F.lit(10.0)


def _hourly(ev: DataFrame, price, volume) -> DataFrame:
    bars = (
        ev.select(
            F.col("event_type").alias("symbol"),
            F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts"),
            price.alias("p"),
            "event_id",
            "k",
        )
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("p", "event_id").alias("o"),
            F.max("p").alias("h"),
            F.min("p").alias("l"),
            F.max_by("p", "event_id").alias("c"),
            volume.alias("v"),
            (F.max_by("k", "event_id") / F.lit(100.0)).alias("base_score"),
        )
    )
    return _with_vwap(bars)


def bars_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type on raw values (few symbols, wild prices)."""
    return _hourly(_events(spark, sf_dir), F.col("value"), F.count(F.lit(1)).cast("long"))


def bars_calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type on a damped price (a mix of barrier outcomes)."""
    return _hourly(_events(spark, sf_dir), calm_price(), F.sum("k").cast("long"))


def bars_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per event for each user: short histories with warm-up nulls."""
    ev = _events(spark, sf_dir)
    bars = ev.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        "ts",
        F.col("value").alias("o"),
        F.col("value").alias("h"),
        F.col("value").alias("l"),
        F.col("value").alias("c"),
        F.col("k").cast("long").alias("v"),
        (F.col("k") / F.lit(100.0)).alias("base_score"),
    )
    return _with_vwap(bars)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a trade on its event type, entered at its time."""
    ev = _events(spark, sf_dir)
    return ev.select(
        F.col("event_id").alias("trade_id"),
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("ts_open"),
        F.when(F.col("event_id") % 2 == 0, F.lit("long")).otherwise(F.lit("short")).alias("side"),
        F.col("k").cast("long").alias("qty"),
        calm_price().alias("entry_px"),
    )
