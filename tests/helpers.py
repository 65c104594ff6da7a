import datetime as dt

from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, ts timestamp_ntz, o double, h double, l double, c double, v bigint, base_score double"


def bars(spark, rows, symbol="X", start=dt.datetime(2024, 1, 2, 9, 15), step_min=5):
    """rows: (o, h, l, c, v[, base_score]) tuples -> canonical bars of one symbol."""
    out = []
    for i, r in enumerate(rows):
        o, h, l, c, v = r[:5]
        bs = r[5] if len(r) > 5 else 0.0
        out.append((symbol, start + dt.timedelta(minutes=step_min * i), float(o), float(h), float(l), float(c),
                    int(v), float(bs)))
    df = spark.createDataFrame(out, BAR_SCHEMA)
    return df.withColumn("vwap", (F.col("h") + F.col("l") + F.col("c")) / F.lit(3.0)).select(
        "symbol", "ts", "o", "h", "l", "c", "v", "vwap", "base_score")


def flat(n, price=100.0, v=1000):
    return [(price, price, price, price, v)] * n
