"""Trading-log extraction as Spark jobs over directories of text logs.

Lines are read with ``spark.read.text`` (one row per line, any number of
files, split across tasks); every field is a ``regexp_extract`` /
``regexp_extract_all`` column, so parsing stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Line markers and patterns of the trade-log format.
ENTRY_MARKERS = ("Worker[", "starting:")
SCAN_MARKER = "symbol,score,ltp,atr%,vwap_dev,vol"
WORKER = r"Worker\[([^\]]+)\]"
ENTRY = r"entry=([\d.]+)"
STOP_T = r"stop_t=([\d.]+)"
STOP_L = r"stop_l=([\d.]+)"
TARGET = r"target=([\d.]+)"
QTY = r"qty=(\d+)"
LEADING_TS = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
# scanner tuple, single or double quotes, signed numbers
TUPLE = r"""\(\s*['"]([^'"]+)['"],\s*(-?[\d.]+),\s*(-?[\d.]+),\s*(-?[\d.]+),\s*(-?[\d.]+),\s*(-?\d+)\)"""
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with the file they came from (plus partition columns of the path)."""
    return spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))


def _num(pattern: str, cast: str = "double"):
    return F.nullif(F.regexp_extract(F.col("value"), pattern, 1), F.lit("")).try_cast(cast)


def trade_entries(lines: DataFrame) -> DataFrame:
    """Lines with ``Worker[`` and ``starting:`` that carry an entry price."""
    v = F.col("value")
    df = lines.filter(v.contains(ENTRY_MARKERS[0]) & v.contains(ENTRY_MARKERS[1]))
    df = df.select(
        "*",
        F.try_to_timestamp(F.nullif(F.regexp_extract(v, LEADING_TS, 1), F.lit("")), F.lit(TS_FORMAT))
        .cast("timestamp_ntz").alias("timestamp"),
        F.nullif(F.regexp_extract(v, WORKER, 1), F.lit("")).alias("symbol"),
        _num(ENTRY).alias("entry"),
        _num(STOP_T).alias("stop_trailing"),
        _num(STOP_L).alias("stop_loss"),
        _num(TARGET).alias("target"),
        _num(QTY, "long").alias("qty"),
    )
    return df.filter(F.col("symbol").isNotNull() & F.col("entry").isNotNull()).drop("value")


def scanner_rows(lines: DataFrame) -> DataFrame:
    """One row per scanned tuple (symbol, score, ltp, atr_pct, vwap_dev, volume)."""
    v = F.col("value")
    df = lines.filter(v.contains(SCAN_MARKER))
    groups = [F.regexp_extract_all(v, F.lit(TUPLE), i) for i in range(1, 7)]
    z = F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups, 1)])
    df = df.select(*[c for c in df.columns if c != "value"], F.explode(z).alias("t"))
    return df.select(
        *[c for c in df.columns if c != "t"],
        F.col("t.g1").alias("symbol"),
        F.col("t.g2").try_cast("double").alias("score"),
        F.col("t.g3").try_cast("double").alias("ltp"),
        F.col("t.g4").try_cast("double").alias("atr_pct"),
        F.col("t.g5").try_cast("double").alias("vwap_dev"),
        F.col("t.g6").try_cast("long").alias("volume"),
    )


def line_types(lines: DataFrame) -> DataFrame:
    """execution / scan / other / unparsed, with the line's timestamp (and symbol for executions)."""
    v = F.col("value")
    head = F.split(F.split(v, " INFO ").getItem(0), ",").getItem(0)
    ts = F.try_to_timestamp(head, F.lit(TS_FORMAT)).cast("timestamp_ntz")
    execution = (v.contains("sell status=") | v.contains("buy status=")) & v.contains("Worker[")
    kind = (
        F.when(ts.isNull(), F.lit("unparsed"))
        .when(execution, F.lit("execution"))
        .when(v.contains("Top scanned"), F.lit("scan"))
        .otherwise(F.lit("other"))
    )
    sym = F.when(kind == "execution", F.split(F.split(v, r"Worker\[").getItem(1), r"\]").getItem(0))
    return lines.select("*", kind.alias("line_type"), ts.alias("timestamp"), sym.alias("symbol"))


def counts(lines: DataFrame, key: str = "file") -> DataFrame:
    """Scanned tuples and trade entries per file (or per another key column)."""
    s = scanner_rows(lines).groupBy(key).agg(F.count(F.lit(1)).alias("scans"))
    e = trade_entries(lines).groupBy(key).agg(F.count(F.lit(1)).alias("entries"))
    return s.join(e, key, "full").select(
        key, F.coalesce("scans", F.lit(0)).alias("scans"), F.coalesce("entries", F.lit(0)).alias("entries"))


def render_fixture_lines(trades: DataFrame) -> DataFrame:
    """Log text for a trades table (test fixture): per trade an entry line (every third without a
    timestamp), a scanner line with two tuples (quote style alternating), an execution line and a
    junk line. Numbers are written with their shortest exact decimal form."""
    ts = F.concat(F.date_format("ts_open", TS_FORMAT), F.lit(","),
                  F.lpad((F.date_format("ts_open", "SSS")), 3, "0"))
    s = lambda c: c.cast("string")
    e = F.col("entry_px")
    q = F.when(F.col("trade_id") % 2 == 0, F.lit("'")).otherwise(F.lit('"'))
    k = F.col("qty")
    entry = F.concat(
        F.when(F.col("trade_id") % 3 != 0, F.concat(ts, F.lit(" INFO "))).otherwise(F.lit("")),
        F.lit("Worker["), F.col("symbol"), F.lit("] starting: entry="), s(e),
        F.lit(" stop_t="), s(e - F.lit(5.0)), F.lit(" stop_l="), s(e - F.lit(6.0)),
        F.lit(" target="), s(e + F.lit(10.0)), F.lit(" qty="), s(k),
    )

    def tup(sym, score, ltp, atr, dev):
        return F.concat(F.lit("("), q, sym, q, F.lit(", "), s(score), F.lit(", "), s(ltp), F.lit(", "), s(atr),
                        F.lit(", "), s(dev), F.lit(", "), s(k), F.lit(")"))

    scan = F.concat(
        ts, F.lit(f" INFO Top scanned ({SCAN_MARKER}): ["),
        tup(F.col("symbol"), k / F.lit(100.0), e, F.lit(0.0015), (k - F.lit(50)) / F.lit(100.0)), F.lit(", "),
        tup(F.concat(F.lit("ALT-"), F.col("symbol")), k / F.lit(10.0), e + F.lit(1.0), F.lit(0.002),
            (F.lit(50) - k) / F.lit(100.0)),
        F.lit("]"),
    )
    exe = F.concat(ts, F.lit(" INFO Worker["), F.col("symbol"), F.lit("] sell status=FILLED"))
    junk = F.concat(F.lit("noise line "), s(F.col("trade_id")))
    return trades.select("symbol", F.explode(F.array(entry, scan, exe, junk)).alias("value"))
