"""Bar normalisation and data quality: column roles, canonical schema,
timestamp parsing, null dropping, OHLC integrity, request-duration clamping,
session filter, review windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DURATION_LIMITS

# Accepted column names per role, in preference order.
ALIASES = {
    "ts": ["timestamp", "ts", "time", "datetime", "date", "Date", "Time", "Timestamp"],
    "o": ["open", "o", "Open", "O", "OPEN"],
    "h": ["high", "h", "High", "H", "HIGH"],
    "l": ["low", "l", "Low", "L", "LOW"],
    "c": ["close", "c", "Close", "C", "CLOSE", "ltp", "price", "last"],
    "v": ["volume", "v", "vol", "Volume", "V", "Vol", "VOLUME"],
    "symbol": ["symbol", "Symbol", "ticker", "Ticker", "stock", "Stock", "SYMBOL"],
}
# Timestamp formats tried in order.
TS_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]
#: A clock time that ends with an offset.
ZONED = r"\d:\d{2}[^+-]*([Zz]|[+-]\d{1,2}(:?\d{2})?)$"
EXCHANGE_TZ = "Asia/Kolkata"
DEFAULT_VOLUME = 10000
SESSION_OPEN_MIN, SESSION_CLOSE_MIN = 9 * 60 + 15, 15 * 60 + 30


def detect(columns: list[str], role: str) -> str | None:
    """Column playing ``role``: exact alias match first, then case-insensitive exact match."""
    names = ALIASES[role]
    for c in columns:
        if c in names:
            return c
    lowered = {n.lower() for n in names}
    for c in columns:
        if c.lower().strip() in lowered:
            return c
    return None


def parse_ts(c) -> F.Column:
    """Exchange wall clock from text or any datetime type (unparsable -> null).

    The formats are tried in order, then the general ISO forms (fractions of a second, ``T``);
    a time with an offset or ``Z`` is converted to the exchange's zone."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c.cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TS_FORMATS]).cast("timestamp_ntz")
    zoned = F.from_utc_timestamp(text.try_cast("timestamp"), EXCHANGE_TZ).cast("timestamp_ntz")
    return F.coalesce(parsed, F.when(F.rlike(text, F.lit(ZONED)), zoned).otherwise(text.try_cast("timestamp_ntz")))


def bars(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Canonical bars ``symbol, ts, o, h, l, c, v, vwap`` from any of the accepted layouts.

    Missing open/high/low default to close, missing volume to 10000, the symbol
    to the column if present, else ``symbol`` (or the ``_symbol`` column set by
    the file reader); vwap is the typical price (h+l+c)/3; rows with any null
    are dropped; no global sort (order lives in the window specs).
    """
    cols = df.columns
    role = {r: detect(cols, r) for r in ALIASES}
    if role["c"] is None:
        raise ValueError(f"no close column among {cols}")
    close = F.col(role["c"]).try_cast("double")
    num = lambda r: F.col(role[r]).try_cast("double") if role[r] else close
    if role["symbol"]:
        sym = F.col(role["symbol"]).cast("string")
    elif symbol is not None:
        sym = F.lit(symbol)
    elif "_symbol" in cols:
        sym = F.col("_symbol")
    else:
        sym = F.lit("UNKNOWN")
    if role["ts"] is None:
        raise ValueError("no timestamp column: supply one (bars without time order are rejected)")
    ts_col = df.schema[role["ts"]].dataType.typeName()
    ts = F.col(role["ts"]).cast("timestamp_ntz") if ts_col.startswith("timestamp") or ts_col == "date" else parse_ts(
        role["ts"])
    vol = F.col(role["v"]).try_cast("double").cast("long") if role["v"] else F.lit(DEFAULT_VOLUME).cast("long")
    out = df.select(sym.alias("symbol"), ts.alias("ts"), num("o").alias("o"), num("h").alias("h"),
                    num("l").alias("l"), close.alias("c"), vol.alias("v"))
    out = out.withColumn("vwap", (F.col("h") + F.col("l") + F.col("c")) / F.lit(3.0))
    return out.dropna()


def load_counts(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """One row: ``rows_read``, ``rows_kept`` and ``rows_rejected`` by ``bars`` (a null in any needed column)."""
    read = raw.agg(F.count("*").alias("rows_read"))
    kept = bars(raw, symbol).agg(F.count("*").alias("rows_kept"))
    return read.join(kept).withColumn("rows_rejected", F.col("rows_read") - F.col("rows_kept"))


def integrity(bars_df: DataFrame) -> DataFrame:
    """Per symbol: counts of h<l, h<c, l>c, negative prices, zero volume; valid iff no negative price."""
    o, h, l, c, v = (F.col(x) for x in "ohlcv")
    neg = (o < 0) | (h < 0) | (l < 0) | (c < 0)
    agg = bars_df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.count_if(h < l).alias("high_below_low"),
        F.count_if(h < c).alias("high_below_close"),
        F.count_if(l > c).alias("low_above_close"),
        F.count_if(neg).alias("negative_prices"),
        F.count_if(v == 0).alias("zero_volume"),
    )
    return agg.withColumn("valid", F.col("negative_prices") == 0)


def limits_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(DURATION_LIMITS.items()), "interval_minutes int, max_days int")


def clamp_duration(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """requests(start, end, interval_minutes): whole-day span over the interval's limit -> start = end - limit.

    Unknown intervals get 30 days. ``limits`` is the fixed 10-row table, broadcast."""
    j = requests.join(F.broadcast(limits), "interval_minutes", "left")
    max_days = F.coalesce(F.col("max_days"), F.lit(30))
    span_days = F.floor((F.unix_micros(F.col("end").cast("timestamp")) -
                         F.unix_micros(F.col("start").cast("timestamp"))) / F.lit(86400 * 10 ** 6)).cast("long")
    over = span_days > max_days
    return j.select(
        *requests.columns,
        span_days.alias("span_days"), max_days.alias("max_days"), over.alias("clamped"),
        F.when(over, (F.col("end") - F.make_dt_interval(days=max_days)).cast("timestamp_ntz"))
        .otherwise(F.col("start")).alias("start_clamped"),
    )


def session_filter(bars_df: DataFrame) -> DataFrame:
    """Bars between 09:15 and 15:30 wall clock (inclusive)."""
    m = F.hour("ts") * 60 + F.minute("ts")
    return bars_df.filter((m >= SESSION_OPEN_MIN) & (m <= SESSION_CLOSE_MIN))


def review_windows(spark: SparkSession, start: date, end: date, freq: str) -> DataFrame:
    """(window_start, window_end) dates: daily, weekly (7 days, last one cut at end) or monthly."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("d"))
    if freq == "daily":
        return days.select(F.col("d").alias("window_start"), F.col("d").alias("window_end"))
    if freq == "weekly":
        ws = spark.range(1).select(
            F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 7 DAYS"))).alias("window_start"))
        return ws.select("window_start", F.least(F.date_add("window_start", 6), F.lit(end)).alias("window_end"))
    if freq == "monthly":
        firsts = days.select(F.when(F.col("d") == F.lit(start), F.col("d"))
                             .when(F.dayofmonth("d") == 1, F.col("d")).alias("window_start")).dropna()
        return firsts.select("window_start", F.least(F.last_day("window_start"), F.lit(end)).alias("window_end"))
    raise ValueError(freq)


def assign_windows(bars_df: DataFrame, windows: DataFrame) -> DataFrame:
    """Bars joined to every review window containing their date (range join on a small calendar)."""
    d = F.to_date("ts")
    return bars_df.join(F.broadcast(windows), (d >= F.col("window_start")) & (d <= F.col("window_end")))
