"""Mixing sources to target weights: documents get hash-random keys, every
source is sorted by them in ranges, distributed prefix sums of the sizes are
taken, and each source is cut at its exact budget after as many whole epochs
as fit.

The keys are hashes, so ranges of equal width over the key space hold about
equally many rows: about sqrt(n) ranges of a source, whichever share of the
rows that source has. A range is one window partition; the range totals (one
row each) give the offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY_BITS = 60
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17


def random_key(doc_id: Column, seed: int = SEED) -> Column:
    """60 bits of md5 of seed and id: the same on every run and in any SQL engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source (``_skey``, ``source_size``) -> ``target``.

    Weights repeat over the sources in key order. A share above ``max_epochs``
    times its source's size stops there and the excess goes to the others by
    weight, until none is above: sorted by cap per weight, the stopped sources
    are a prefix, so one pass of running sums finds it.
    """
    everything = W.partitionBy()
    listed = F.array(*[F.lit(int(w)) for w in weights])
    rank = F.row_number().over(W.orderBy("_skey"))
    s = sizes.withColumn("_w", F.element_at(listed, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * max_epochs)
    fill = W.orderBy(F.col("_cap") / F.col("_w"), "_skey")
    s = s.select(
        "*",
        F.row_number().over(fill).alias("_i"),
        (F.sum("source_size").over(everything)
         - F.coalesce(F.sum("_cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_left"),
        F.sum("_w").over(fill.rowsBetween(0, W.unboundedFollowing)).alias("_rest"),
    )
    share = F.col("_left").cast("double") * F.col("_w") / F.col("_rest")
    s = s.withColumn("_first", F.min(F.when(share <= F.col("_cap"), F.col("_i"))).over(everything))
    at_first = [F.max(F.when(F.col("_i") == F.col("_first"), F.col(c))).over(everything) for c in ("_left", "_rest")]
    target = F.when(F.col("_i") < F.col("_first"), F.col("_cap").cast("double")).otherwise(
        at_first[0].cast("double") * F.col("_w") / at_first[1])
    return s.select("_skey", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: str = "size", *, source: str = "source", doc_id: str = "doc_id", rows: int | None = None,
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``taken`` and ``copies``.

    ``size`` names a long column without nulls. ``taken`` is the size the mix
    takes from the row over all epochs; per source it adds up to the whole part
    of ``target``, for the row at the cut gives only what is missing.
    ``copies`` is the number of epochs that reach the row (a row at the cut
    counts whole). Null sources are one source, last in order; a source
    without any size takes nothing. Rows with equal keys go by id and size, so
    reruns agree. Result columns must not be in ``docs``.
    """
    n = docs.count() if rows is None else rows
    width = (1 << KEY_BITS) // max(1, math.isqrt(n)) + 1
    src = F.col(source).cast("string")
    keyed = (docs.withColumn("_skey", F.when(src.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), src)))
             .withColumn("_key", random_key(F.col(doc_id), seed))
             .withColumn("_range", F.expr(f"_key div {width}L")))
    ranges = keyed.groupBy("_skey", "_range").agg(F.sum(size).alias("_range_size"))
    sources = source_targets(ranges.groupBy("_skey").agg(F.sum("_range_size").alias("source_size")), weights, max_epochs)
    earlier = W.partitionBy("_skey").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (ranges.withColumn("_offset", F.coalesce(F.sum("_range_size").over(earlier), F.lit(0)))
               .drop("_range_size").join(sources, "_skey"))
    inside = W.partitionBy("_skey", "_range").orderBy("_key", doc_id, size).rowsBetween(W.unboundedPreceding, -1)
    mixed = keyed.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(offsets, ["_skey", "_range"])
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div nullif(source_size, 0)")).otherwise(F.lit(0))
    before, rest = F.col("_offset") + F.col("_inside"), budget - whole * F.col("source_size")
    part = F.least(F.greatest(rest - before, F.lit(0)), F.col(size))
    return mixed.select(
        *docs.columns, "source_size", "target",
        (whole * F.col(size) + part).cast("long").alias("taken"),
        (whole + F.when(before < rest, 1).otherwise(0)).cast("int").alias("copies"),
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every row as often as its ``copies`` says."""
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)
