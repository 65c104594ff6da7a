"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks by a hash, queries into blocks too, and every
pair of a query block and a vector block is one unit of work. A unit sorts its
vectors once per dimension. A query reads the lists in parallel from its
favourable end (dimensions it has 0 in are not read), scores each vector when
it first meets it, and stops when the sum over dimensions of what the lists
offer at that depth is below its kth score: no vector unseen can do better.
The units' results, k per query, are ranked once more.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

K = 20
SCALE = 64
#: Vectors and queries of one block on average.
VECTORS, QUERIES = 2048, 8192
#: Depth of the first look at the bound; it doubles from look to look.
FIRST = 64
#: Sums of whole doubles below this are exact.
EXACT = 2.0**53
#: Scores beyond it are given as it: what a long holds, on either side.
LARGEST = 2**63 - 1


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) -> ``vec_id, v``: floor(scale * x) of each component as
    double (a product beyond the doubles: the last of them). Vectors that are
    null or hold a null, NaN or infinite component are left out; an empty
    vector has score 0 with all."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def floored(c):  # from 2^53 on every double is whole, and floor() would end at 2^63
        y = F.greatest(F.least(c * F.lit(float(scale)), F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    whole = F.transform(x, floored)
    return vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(~odd).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, shorter ones filled with zeros."""
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten())
    return out


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products: of doubles, or of Python's integers as int64 within LARGEST."""
    found = rows @ query
    return np.array([max(-LARGEST, min(LARGEST, s)) for s in found], np.int64) if found.dtype == object else found


def _integers(a: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    return np.array([int(x) for x in a.ravel().tolist()], object).reshape(a.shape)


def threshold_search(ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, steps: np.ndarray, query_id: int, query: np.ndarray, k: int):
    """(ids, scores, lists read to) of the query's k best, ties to smaller ids.

    ``lists``: per dimension (column) the rows by ascending value; ``steps``:
    depths at which the bound is looked at, the last one the lists' length.
    Vectors and query are whole doubles, or Python's integers in object arrays.
    """
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    weight = np.concatenate([query[up], query[down]])
    n, seen = len(ids), np.zeros(len(ids), bool)
    own = ids == query_id
    seen[own] = True
    if not len(weight):  # every score is 0, and so is the bound
        best = np.sort(ids[~own])[:k]
        return best, np.zeros(len(best)), n
    rows, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64 if query.dtype == object else np.float64), 0
    for depth in steps:
        met = np.zeros(n, bool)
        met[lists[n - depth : n - at, up]] = True
        met[lists[at:depth, down]] = True
        new = np.flatnonzero(met & ~seen)
        seen[new] = True
        rows, scores, at = np.concatenate([rows, new]), np.concatenate([scores, _products(vectors[new], query)]), depth
        if len(rows) >= k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= least], scores[scores >= least]
            offered = np.concatenate([vectors[lists[n - depth, up], up], vectors[lists[depth - 1, down], down]])
            if least > _products(offered[None], weight)[0]:  # an equal one could still have a smaller id
                break
    order = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows[order]], scores[order], at


def _unit(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        width = int(max(np.asarray(table.column("v").combine_chunks().value_lengths()).max(initial=0), 1))
        query = np.asarray(table.column("is_query"))
        ids = np.asarray(table.column("vec_id"))
        every = _matrix(table.column("v").combine_chunks(), width)
        vectors, mine, queries, asked = every[~query], ids[~query], every[query], ids[query]
        out = ([], [], [])
        if len(mine):
            lists, n = np.argsort(vectors, axis=0, kind="stable"), len(mine)
            steps = np.unique(np.minimum([FIRST << i for i in range(n.bit_length() + 1)], n))
            top, whole = float(np.abs(vectors).max(initial=0)), None
            for q, v in zip(asked.tolist(), queries):
                held = vectors
                if width * top * float(np.abs(v).max(initial=0)) >= EXACT:  # doubles would round
                    whole = _integers(vectors) if whole is None else whole
                    held, v = whole, _integers(v)
                best, scores, _ = threshold_search(mine, held, lists, steps, q, v, k)
                out[0].append(np.full(len(best), q)), out[1].append(best), out[2].append(scores.astype(np.int64))
        join = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(join[0].astype(np.int64)), "vec_id": pa.array(join[1].astype(np.int64)), "score": pa.array(join[2].astype(np.int64))})

    return run


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K, block: int = VECTORS, query_block: int = QUERIES) -> DataFrame:
    """(vec_id, v), twice -> ``query_id, rank, vec_id, score``: each query's k
    highest inner products with vectors of another id, ties to the smaller id,
    fewer if there are fewer. Shorter vectors count as filled with zeros;
    repeated rows of an id are candidates of their own. Scores that doubles
    cannot hold are computed in integers; one beyond a long counts as the last
    long on its side."""
    vectors, queries = checkpointed(spark, vectors), checkpointed(spark, queries)
    n, m = 1 + vectors.count() // block, 1 + queries.count() // query_block

    def dealt(df: DataFrame, is_query: bool, own: int, others: int):
        mine, other = F.pmod(F.xxhash64("vec_id", "v"), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        row = df.select("vec_id", "v", F.lit(is_query).alias("is_query"), mine.alias("mine"), other.alias("other"))
        return row.withColumn("unit", F.col("other") * m + F.col("mine") if is_query else F.col("mine") * m + F.col("other")).drop("mine", "other")

    units = dealt(vectors, False, n, m).union(dealt(queries, True, m, n))
    found = units.groupBy("unit").applyInArrow(_unit(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
