"""File sources and sinks: CSV/Parquet bars of any layout, candle payloads,
trades CSV, the per-symbol bar store and its catalog, review sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import normalize
from ..operators.normalize import EXCHANGE_TZ

#: Columns of a trades file; a file may leave some out and have them in any order.
TRADES_SCHEMA = T.StructType([
    T.StructField("trade_id", T.LongType()),
    T.StructField("ts_open", T.TimestampNTZType()),
    T.StructField("ts_close", T.TimestampNTZType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("qty", T.LongType()),
    T.StructField("entry_px", T.DoubleType()),
    T.StructField("exit_px", T.DoubleType()),
    T.StructField("tp", T.DoubleType()),
    T.StructField("sl", T.DoubleType()),
    T.StructField("base_score", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("notes", T.StringType()),
])
#: Tasks a core that write and list the store.
TASKS_PER_CORE = 4
CANDLES_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("candles", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


def symbol_from_path(path_col=None) -> F.Column:
    """Symbol from a ``symbol=<name>`` directory, else the file stem; upper case, '_' -> '-'."""
    path_col = F.col("_metadata.file_path") if path_col is None else path_col
    part = F.regexp_extract(path_col, r"symbol=([^/]+)/", 1)
    stem = F.regexp_extract(path_col, r"([^/]+?)(\.[^./]*)?$", 1)
    raw = F.when(part != "", part).otherwise(stem)
    return F.upper(F.replace(raw, F.lit("_"), F.lit("-")))


def read_bars(spark: SparkSession, path: str, fmt: str | None = None, symbol: str | None = None) -> DataFrame:
    """Bars from CSV or Parquet files in any accepted column layout -> canonical bars.

    CSV is read as text (no inference pass over the data) and cast by
    ``normalize.bars``; without a symbol column the symbol comes from the path."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "csv":
        # recursive lookup: no partition inference, the symbol comes from the path
        raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    else:
        raw = spark.read.parquet(path)
    raw = raw.withColumn("_symbol", symbol_from_path())
    return normalize.bars(raw, symbol)


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Candle payloads {"symbol", "candles": [[epoch_s, o, h, l, c, v], ...]} -> canonical bars
    with exchange-local (IST) wall-clock timestamps and typical-price vwap."""
    raw = spark.read.schema(CANDLES_SCHEMA).json(path)
    c = raw.select("symbol", F.explode("candles").alias("k"))
    k = F.col("k")
    ts = F.from_utc_timestamp(F.timestamp_seconds(F.get(k, 0).cast("long")), EXCHANGE_TZ).cast("timestamp_ntz")
    out = c.select("symbol", ts.alias("ts"), F.get(k, 1).alias("o"), F.get(k, 2).alias("h"),
                   F.get(k, 3).alias("l"), F.get(k, 4).alias("c"), F.get(k, 5).cast("long").alias("v"))
    return out.withColumn("vwap", (F.col("h") + F.col("l") + F.col("c")) / F.lit(3.0))


def write_candles(bars_df: DataFrame, path: str) -> None:
    """Land bars as candle payloads, one record per (symbol, day) so no payload grows with history."""
    epoch = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    row = F.array(epoch, F.col("o"), F.col("h"), F.col("l"), F.col("c"), F.col("v").cast("double"))
    day = F.to_date("ts")
    (bars_df.groupBy("symbol", day.alias("day"))
     .agg(F.sort_array(F.collect_list(F.struct(F.col("ts"), row.alias("r")))).alias("rows"))
     .select("symbol", F.transform("rows", lambda x: x["r"]).alias("candles"))
     .write.mode("overwrite").json(path))


TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trades from CSV files, columns found by their name in the header (any case, any order);
    a column that the file lacks, and a value that does not parse, is null."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    found = {c.strip().lower(): F.col(f"`{c}`") for c in raw.columns}

    def column(field: T.StructField):
        if field.name not in found:
            return F.lit(None).cast(field.dataType)
        if isinstance(field.dataType, T.TimestampNTZType):
            return normalize.parse_ts(found[field.name])
        return found[field.name].try_cast(field.dataType)

    return raw.select(*[column(f).alias(f.name) for f in TRADES_SCHEMA.fields])


def store_write(bars_df: DataFrame, path: str) -> None:
    """Per-symbol bar store: Parquet partitioned by symbol, rows clustered by time inside each
    partition; replaces only the partitions being written (dynamic overwrite)."""
    # range partitioning spreads a hot symbol over several tasks/files; the time is that of making directories and
    # files, not of bytes, so several tasks a core even it out (by bytes the tasks would be about as many as cores)
    spark = bars_df.sparkSession
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (bars_df.repartitionByRange(tasks, "symbol", "ts").sortWithinPartitions("symbol", "ts")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("symbol").parquet(path))


def store_read(spark: SparkSession, path: str, symbols: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Bars of the store. With ``schema`` symbols keep its type and are not guessed from the directories' names.

    The directories are listed by a few tasks a core (by default Spark starts a task for each, up to 10,000)."""
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    spark.conf.set(listing, min(int(before), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    finally:
        spark.conf.set(listing, before)
    return df.filter(F.col("symbol").isin(symbols)) if symbols else df


def catalog(stored: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """rows, first and last ts per stored symbol, and whether a model is registered for it."""
    cat = stored.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"),
                                       F.max("ts").alias("last_ts"))
    if registry is None:
        return cat.withColumn("has_model", F.lit(False))
    models = registry.select("symbol").distinct().withColumn("has_model", F.lit(True))
    return cat.join(models, "symbol", "left").withColumn("has_model", F.coalesce("has_model", F.lit(False)))


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str = "none") -> None:
    w = (df.write.mode("overwrite").option("header", True).option("escape", '"').option("timestampNTZFormat", TS_TEXT)
         .option("compression", compression))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_review(rows: DataFrame, path: str) -> None:
    """Review rows as CSV, one directory for a day (of ``ts``). Days that ``rows`` have are replaced whole,
    so a day can be written again; others stay.

    Rows are range-partitioned by time, so a day's files come from few tasks and a day that holds most rows
    is spread over several."""
    (rows.withColumn("review_date", F.date_format("ts", "yyyy-MM-dd")).repartitionByRange("ts", "symbol")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("review_date")
     .option("header", True).option("escape", '"').option("timestampNTZFormat", TS_TEXT).csv(path))


def read_review(spark: SparkSession, path: str, schema: T.StructType, days: list[str] | None = None) -> DataFrame:
    """Review rows of all days or of ``days`` (yyyy-MM-dd; only their directories are read), with ``review_date``."""
    full = T.StructType([*schema.fields, T.StructField("review_date", T.StringType())])
    df = spark.read.option("header", True).option("escape", '"').option("timestampNTZFormat", TS_TEXT).schema(full).csv(path)
    return df.filter(F.col("review_date").isin(days)) if days else df
