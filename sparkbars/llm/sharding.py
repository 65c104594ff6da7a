"""Sharding by sampled splitters: keys are sampled in proportion to the sizes,
quantiles of the sample become range boundaries, records are partitioned by
range, ranges found overfull are subdivided by a denser sample of their own,
and exact prefix sums over ranges and rows give every record its shard.

The key is (hash of the text, hash of the id): equal texts are neighbours, and
a text that a third of all rows have is still spread over many ranges.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Sampled keys per range, and the most ranges of the first round: together they
#: bound what reaches the driver (boundaries) and one task (sampled keys).
PER_RANGE = 64
MAX_RANGES = 8192
ROUNDS = 3


def _key():
    text = F.shiftrightunsigned(F.xxhash64("text"), 32)
    row = F.shiftrightunsigned(F.xxhash64(F.lit("row"), "doc_id"), 44)
    return (text * F.lit(1 << 20) + row).cast("double")


def _uniform(salt: str):
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), "doc_id", "_key"), 11).cast("double") / F.lit(float(1 << 53))


def _drawn(expected, salt: str):
    """How often a row is in the sample: ``expected`` times on average."""
    return (F.floor(expected) + (_uniform(salt) < expected - F.floor(expected)).cast("long"))


def _ranged(rows: DataFrame, splits: list[float]) -> DataFrame:
    cut = Bucketizer(splits=[-math.inf, *(splits or [0.0]), math.inf], inputCol="_key", outputCol="_range")
    return cut.transform(rows.drop("_range")).withColumn("_range", F.col("_range").cast("int"))


def _splitters(rows: DataFrame, n: int, total: int) -> tuple[list[float], DataFrame]:
    """Range boundaries, and the rows with their ``_range``."""
    ranges = min(MAX_RANGES, max(1, math.isqrt(n)))
    if ranges < 2:
        return [], _ranged(rows, [])
    drawn = _drawn(F.lit(float(PER_RANGE * ranges) / total) * F.col("size"), "first")
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    sample = rows.select("_key", drawn.alias("_times")).filter("_times > 0")
    found = sample.agg(F.percentile("_key", at, F.col("_times")).alias("at")).first()["at"]
    splits = sorted(set(found or []))
    for _ in range(ROUNDS):
        rows = _ranged(rows, splits)
        fill = F.greatest(F.col("n") * (ranges / n), F.col("bytes") * (ranges / total))
        over = (rows.groupBy("_range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
                .withColumn("k", F.ceil(fill).cast("int")).filter("k > 2 and n > 1"))
        # one row per overfull range, so at most as many rows as there are ranges
        expected = F.lit(PER_RANGE / 2.0) * F.col("k") * (1 / F.col("n") + F.col("size") / F.col("bytes"))
        keys = (rows.join(F.broadcast(over), "_range").select("_range", "k", "_key", _drawn(expected, "again").alias("_times"))
                .filter("_times > 0").groupBy("_range", "k").agg(F.sort_array(F.collect_list("_key")).alias("keys")))
        cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1),
                           lambda i: F.element_at("keys", (F.floor(i * F.size("keys") / F.col("k")) + 1).cast("int")))
        more = {x for r in keys.select(cuts.alias("cuts")).collect() for x in r["cuts"]} - set(splits)
        if not more:
            break
        splits = sorted({*splits, *more})
    return splits, _ranged(rows, splits)


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, text) -> ``doc_id, size, text_crc32, shard, slot``: shards of near
    equal bytes, numbered in key order; ``slot`` counts from 0 in each.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1). A record goes where the
    bytes before it fall, so a shard is off its share by one record at most.
    Repeated rows get slots of their own. No rows, no shards.
    """
    rows = checkpointed(spark, docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), _key().alias("_key")))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(1))).first()
    splits, rows = _splitters(rows, n, total)
    totals = rows.groupBy("_range").agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # over one row per range
    offsets = totals.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_bytes")])
    inside = W.partitionBy("_range").orderBy("_key", "doc_id", "text_crc32", "size")
    placed = rows.select("*", F.row_number().over(inside).alias("_rn"),
                         F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_in_bytes"))
    placed = placed.join(offsets, "_range").select(
        "doc_id", "size", "text_crc32", (F.col("_n_before") + F.col("_rn") - 1).alias("_at"),
        F.least(F.expr(f"((_bytes_before + _in_bytes) * {shards}) div {total}L"), F.lit(shards - 1)).cast("int").alias("shard"))
    starts = placed.groupBy("shard").agg(F.min("_at").alias("_start"))  # one row per shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_start")).cast("long").alias("slot"))
