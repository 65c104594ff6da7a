"""Approximate nearest neighbours with learned partitions.

A bounded sample of the vectors gives a graph of nearest neighbours. The graph
is cut into partitions of equal size by bisecting it again and again: halves
along the widest direction, then swaps of vertices that take most edges off the
cut. A small network learns, from a vector, in which partitions its neighbours
lie. All vectors are placed in their most probable partition; a query goes to
its most probable partitions until their probabilities add up to a mass that a
comparison with brute force over all vectors has set, and what lies there is
ranked by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

K = 10
#: Vectors that the partitions are learned from, at most; neighbours of each in the graph.
SAMPLE, DEGREE = 8192, 10
#: Partitions (a power of two), and vectors of the sample that each has at least.
PARTITIONS, LEAST_SAMPLE = 32, 64
#: The network: hidden units, passes over the sample, vectors of a step.
HIDDEN, EPOCHS, STEP = 128, 30, 256
#: Queries that set the mass, compared with all vectors, and the recall it must give them.
TRIALS, RECALL = 256, 0.96
#: Vectors of a partition, and queries, that one unit of work holds on average.
VECTORS, QUERIES = 4096, 4096


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v`` (doubles) of the vectors that take part: with an id, not
    null, empty or zero, and without null, NaN or infinite components."""
    x = F.transform(embedding, lambda c: c.cast("double"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.filter(~odd).filter(F.exists("v", lambda c: c != 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, shorter ones filled with zeros."""
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten())
    return out


def nearest(queries: np.ndarray, asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, distances) of each query's k nearest vectors of another id, ties to
    smaller ids, none farther than its ``bound``. Products choose what may be
    among them, with a margin for rounding; differences give the distances."""
    of_vectors = np.einsum("ij,ij->i", vectors, vectors)
    most = of_vectors.max(initial=0)
    for at in range(0, len(queries), 64):
        some = queries[at : at + 64]
        with np.errstate(over="ignore", invalid="ignore"):
            near = of_vectors - 2 * (some @ vectors.T)
        for i, (q, own) in enumerate(zip(some, asked[at : at + 64])):
            others = np.flatnonzero(ids != own)
            score, margin = near[i, others], 1e-12 * (most + q @ q) * (2 + len(q))
            if len(others) > k and np.isfinite(score).all():
                others = others[score <= np.partition(score, k - 1)[k - 1] + 2 * margin]
            d = np.sqrt(((vectors[others] - q) ** 2).sum(axis=1))
            if bound is not None:
                others, d = others[d <= bound[at + i]], d[d <= bound[at + i]]
            by = np.lexsort((ids[others], d))[:k]
            yield others[by], d[by]


def bisect(x: np.ndarray, pairs: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Halves (0 and 1, of equal size) of a graph's vertices ``x`` that few of the
    edges ``pairs`` join."""
    n = len(x)
    centred = x - x.mean(axis=0)
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    side = np.ones(n)
    side[np.argsort(centred @ axis, kind="stable")[: n // 2]] = -1
    a, b = pairs.T
    best, least = side.copy(), np.inf
    for _ in range(rounds):
        cut = (side[a] != side[b]).sum()
        if cut >= least:
            break
        best, least = side.copy(), cut
        pull = np.bincount(a, side[b], n) + np.bincount(b, side[a], n)
        gain = -side * pull  # edges that a vertex takes off the cut by changing sides
        up, down = np.flatnonzero(side > 0), np.flatnonzero(side < 0)
        up, down = up[np.argsort(-gain[up], kind="stable")], down[np.argsort(-gain[down], kind="stable")]
        m = min(len(up), len(down))
        swaps = int((gain[up[:m]] + gain[down[:m]] > 0).sum())
        swaps = (swaps + 1) // 2  # neighbours that change together undo each other
        if not swaps:
            break
        side[up[:swaps]], side[down[:swaps]] = -1, 1
    return (best > 0).astype(np.int64)


def partition(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A partition of each vertex; ``graph``: neighbours of each, -1 for none."""
    label = np.zeros(len(x), np.int64)
    a = np.repeat(np.arange(len(x)), graph.shape[1])
    pairs = np.stack([a, graph.ravel()], axis=1)
    pairs = pairs[pairs[:, 1] >= 0]
    levels = parts.bit_length() - 1
    for _ in range(levels):
        inner = pairs[label[pairs[:, 0]] == label[pairs[:, 1]]]
        of = label[inner[:, 0]]
        new = label * 2
        for part in np.unique(label):
            rows = np.flatnonzero(label == part)
            place = np.full(len(x), -1, np.int64)
            place[rows] = np.arange(len(rows))
            new[rows] += bisect(x[rows], place[inner[of == part]]) if len(rows) > 1 else 0
        label = new
    return label


@dataclass
class Router:
    """The network: from a vector to probabilities of the partitions."""

    scale: float
    layers: list[np.ndarray]  # weights and biases of two layers

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.maximum(np.clip(x / self.scale, -1e3, 1e3) @ w1 + b1, 0) @ w2 + b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, target: np.ndarray, seed: int = 7) -> Router:
    """Adam over the cross entropy to the distributions ``target``."""
    rng = np.random.default_rng(seed)
    scale = float(np.sqrt((x / (top := np.abs(x).max() or 1.0)) ** 2).mean() * top) or 1.0
    n, width, parts = len(x), x.shape[1], target.shape[1]
    layers = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    mean, square = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    x, step = np.clip(x / scale, -1e3, 1e3), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        rate = 3e-3 * (1 - epoch / EPOCHS)
        for at in range(0, n, STEP):
            rows = order[at : at + STEP]
            h = np.maximum(x[rows] @ layers[0] + layers[1], 0)
            z = h @ layers[2] + layers[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            error = (e / e.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (error @ layers[2].T) * (h > 0)
            step += 1
            for p, g, m, s in zip(layers, (x[rows].T @ back, back.sum(axis=0), h.T @ error, error.sum(axis=0)), mean, square):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Router(scale, layers)


def learn(x: np.ndarray, parts: int = PARTITIONS) -> Router:
    """A router from a sample: graph, partitions, network. Fewer partitions, a
    power of two, if the sample has not LEAST_SAMPLE vectors for each."""
    while parts > 1 and len(x) < parts * LEAST_SAMPLE:
        parts //= 2
    k = min(DEGREE, len(x) - 1)
    graph = np.full((len(x), max(k, 1)), -1, np.int64)
    for i, (rows, _) in enumerate(nearest(x, np.arange(len(x)), x, np.arange(len(x)), k) if k else []):
        graph[i, : len(rows)] = rows
    label = partition(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 1.0)  # its own partition, and those of its neighbours
    for column in graph.T:
        has = column >= 0
        np.add.at(target, (np.flatnonzero(has), label[column[has]]), 1.0)
    return train(x, target / target.sum(axis=1, keepdims=True))


def fit(vectors: DataFrame, width: int, sample: int = SAMPLE, parts: int = PARTITIONS) -> Router:
    """Learns in one task from up to ``sample`` vectors, those of the smallest hashes."""
    chosen = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.zeros((0, width)), *[matrix(b.column("v"), width) for b in batches]])
        if len(x):
            x = x[np.lexsort(x.T[::-1])]
            router = learn(x, parts)
            yield pa.RecordBatch.from_pydict({"scale": [router.scale], "layers": pa.array([[p.ravel() for p in router.layers]], pa.list_(pa.list_(pa.float64())))})

    row = chosen.mapInArrow(run, "scale double, layers array<array<double>>").first()  # one row of a few thousand numbers
    if row is None:
        return Router(1.0, [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)])
    w1, b1, w2, b2 = map(np.array, row["layers"])
    return Router(row["scale"], [w1.reshape(width, HIDDEN), b1, w2.reshape(HIDDEN, -1), b2])


_FOUND = "query_id bigint, vec_id bigint, score double"


def _table(query: list, vec: list, score: list) -> pa.Table:
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
    return pa.table({"query_id": join(query, pa.int64()), "vec_id": join(vec, pa.int64()), "score": join(score, pa.float64())})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def brute_force(vectors: DataFrame, queries: DataFrame, width: int, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of a bounded set of queries against all
    vectors; every task holds the queries and its best of each."""
    rows = queries.select("vec_id", "v").collect()
    asked = np.array([r["vec_id"] for r in rows], np.int64)
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r["v"])] = r["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
        for batch in batches:
            ids, v = np.asarray(batch.column("vec_id")), matrix(batch.column("v"), width)
            for i, (found, d) in enumerate(nearest(x, asked, v, ids, k)):
                one, two = np.concatenate([best[i][0], ids[found]]), np.concatenate([best[i][1], d])
                by = np.lexsort((one, two))[:k]
                best[i] = one[by], two[by]
        out = _table([np.full(len(b[0]), q) for q, b in zip(asked, best)], [b[0] for b in best], [b[1] for b in best])
        yield from out.combine_chunks().to_batches()

    return _ranked(vectors.select("vec_id", "v").mapInArrow(run, _FOUND), k)


def _routed(rows: DataFrame, router: Router, width: int, mass: float | None) -> DataFrame:
    """``vec_id, v, part, nth``: the most probable partition of each row, or as
    many as ``mass`` takes, the nth first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = router.probabilities(matrix(batch.column("v"), width))
            order = np.argsort(-p, axis=1, kind="stable")
            upto = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
            taken = np.ones(len(p), np.int64) if mass is None else np.minimum((upto < mass).sum(axis=1) + 1, p.shape[1])
            row = np.repeat(np.arange(len(p)), taken)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(taken) - taken, taken)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(order[row, nth].astype(np.int32)), pa.array(nth.astype(np.int32))],
                names=["vec_id", "v", "part", "nth"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id bigint, v array<double>, part int, nth int")


def _mass(placed: DataFrame, router: Router, width: int, k: int, trials: int, recall: float) -> float:
    """The least probability mass in whose partitions ``trials`` vectors find the
    ``recall`` of their true nearest among all vectors."""
    some = placed.orderBy(F.xxhash64(F.lit("trial"), "vec_id", "v")).limit(trials)
    asked = some.select("vec_id", "v").collect()
    if not asked:
        return 1.0
    true = brute_force(placed, some, width, k).join(placed.select("vec_id", "part"), "vec_id")  # trials * k rows
    true = true.groupBy("query_id", "part").count().collect()
    x = np.zeros((len(asked), width))
    for i, r in enumerate(asked):
        x[i, : len(r["v"])] = r["v"]
    p = router.probabilities(x)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.zeros_like(p)  # mass that must be exceeded for a partition to be read
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1), axis=1)
    place = {r["vec_id"]: i for i, r in enumerate(asked)}
    need = np.array([before[place[r["query_id"]], r["part"]] for r in true])
    often = np.array([r["count"] for r in true])
    by = np.argsort(need)
    enough = np.searchsorted(np.cumsum(often[by]), recall * often.sum())
    return float(min(need[by[min(enough, len(by) - 1)]] + 1e-9, 1.0)) if len(need) else 1.0


def _unit(k: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query, ids = np.asarray(table.column("bound")), np.asarray(table.column("vec_id"))
        every = matrix(table.column("v").combine_chunks(), width)
        is_query = ~np.isnan(query)
        mine, asked = ids[~is_query], ids[is_query]
        found = list(nearest(every[is_query], asked, every[~is_query], mine, k, query[is_query])) if len(mine) else []
        return _table([np.full(len(f[0]), q) for q, f in zip(asked, found)], [mine[f[0]] for f in found], [f[1] for f in found])

    return run


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, parts: int = PARTITIONS,
           trials: int = TRIALS, recall: float = RECALL, block: int = VECTORS, query_block: int = QUERIES) -> DataFrame:
    """(vec_id, v) as ``usable`` gives them, twice -> ``query_id, rank, vec_id,
    score``: the k vectors of another id at the smallest Euclidean distance that
    the partitions of each query hold, ties to the smaller id, all if fewer.

    The router is learned from at most ``sample`` vectors, every vector is
    placed. A partition of many vectors is split into blocks, all of which its
    queries read: first one block of the most probable partition, whose kth
    distance bounds what the others return. Shorter vectors count as filled with
    zeros; repeated rows of an id are candidates of their own, repeated queries
    are asked once; distances beyond doubles are infinite and rank last."""
    vectors, queries = checkpointed(spark, vectors.select("vec_id", "v")), checkpointed(spark, queries.select("vec_id", "v").dropDuplicates(["vec_id"]))
    width, n = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(1)), F.count("*")).first()
    width = max(width, queries.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0])
    router = fit(vectors, width, sample, parts)
    placed = checkpointed(spark, _routed(vectors, router, width, None).drop("nth"))
    sizes = dict(placed.groupBy("part").count().collect())  # one row per partition
    mass = _mass(placed, router, width, k, trials, recall)
    blocks = F.create_map(*[F.lit(x) for p, size in sizes.items() for x in (p, 1 + (size - 1) // block)]) if sizes else F.create_map(F.lit(-1), F.lit(1))
    query_blocks = 1 + queries.count() // query_block
    stored = placed.select("part", F.pmod(F.xxhash64("vec_id", "v"), blocks[F.col("part")]).cast("int").alias("block"), "vec_id", "v", F.lit(float("nan")).alias("bound"))
    asked = checkpointed(spark, _routed(queries, router, width, mass).filter(F.col("part").isin(*sizes) if sizes else F.lit(False)))
    to = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("part")].cast("int") - 1)))
    first = (F.col("nth") == 0) & (F.col("block") == 0)
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")

    def scan(stored: DataFrame, to: DataFrame) -> DataFrame:
        copies = stored.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        units = copies.unionByName(to.select("part", "block", "vec_id", "v", "bound", chunk.alias("chunk")))
        return units.groupBy("part", "block", "chunk").applyInArrow(_unit(k, width), _FOUND)

    nearby = checkpointed(spark, scan(stored.filter("block = 0"), to.filter(first).withColumn("bound", F.lit(float("inf")))))
    bound = nearby.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("worst"))
    bound = bound.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("worst")).otherwise(float("inf")).alias("bound"))
    rest = to.filter(~first).join(bound, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    found = nearby.unionByName(scan(stored, rest))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
