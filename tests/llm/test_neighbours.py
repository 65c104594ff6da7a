"""Learned partitions: recall against brute force, exact distances, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbars.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label int, v string, part int, bound string"


def _write(spark, path, rows):
    spark.createDataFrame([(*r, 1, "v", 2, "b") for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")


def brute(rows, k=10, every=100):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    width = max((len(v) for _, v in rows), default=0)
    rows = [(i, np.pad(v, (0, width - len(v)))) for i, v in rows]
    out = {}
    for q, x in rows:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in rows if i != q)[:k]
    return out


def _recall(found, true):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return sum(len(got.get(q, set()) & {i for _, i in best}) for q, best in true.items()) / max(1, sum(map(len, true.values())))


@pytest.mark.parametrize("kind", ["clusters", "sphere", "one cluster"])
def test_recall(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    n, d = 4000, 16
    if kind == "clusters":
        x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.2 * rng.normal(size=(n, d))
    elif kind == "sphere":
        x = rng.normal(size=(n, d))
    else:  # a third of all rows are near copies, a sixth are equal
        x = rng.normal(size=(n, d))
        x[: n // 3] = x[0] + 0.01 * rng.normal(size=(n // 3, d))
        x[n // 3 : n // 2] = x[-1]
    rows = [(int(i), x[i].tolist()) for i in rng.permutation(n)]
    _write(spark, tmp_path, rows)
    vectors = neighbours.usable(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    found = neighbours.search(spark, vectors, vectors.filter("vec_id % 100 = 0"), sample=2048, parts=16, block=300, query_block=7).collect()
    true = brute(rows)
    assert _recall(found, true) >= 0.9
    of = {r["query_id"]: [] for r in found}
    exact = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        assert r["score"] == np.sqrt(((exact[r["vec_id"]] - exact[r["query_id"]]) ** 2).sum())
        of[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(of) == set(true) and all(len(v) == 10 and v == sorted(v) for v in of.values())


def test_routing_reads_a_part_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(64, 16))[rng.integers(0, 64, 6000)] + 0.1 * rng.normal(size=(6000, 16))
    router = neighbours.learn(x[:3000], 16)
    p = router.probabilities(x[3000:])
    sizes = np.bincount(p.argmax(axis=1), minlength=16)
    assert sizes.max() < 4 * sizes.mean()  # learned partitions stay near equal
    top = np.sort(p, axis=1)[:, ::-1]
    assert (np.cumsum(top, axis=1) < 0.96).sum(axis=1).mean() < 4  # few partitions hold a query's neighbours


def test_bisection_is_balanced_and_cuts_little():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(50, 4)) + 3, rng.normal(size=(50, 4)) - 3])
    graph = np.array([rows for rows, _ in neighbours.nearest(x, np.arange(100), x, np.arange(100), 5)])
    label = neighbours.partition(x, graph, 2)
    assert sorted(np.bincount(label)) == [50, 50] and len(set(label[:50])) == 1
    assert sorted(np.bincount(neighbours.partition(x, graph, 8))) == [12] * 4 + [13] * 4


def test_odd_rows_are_exact_when_all_is_read(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [1.0, 2.0]), (7, [1.0, 2.0]), (3, [1.0, 2.0]), (200, None), (300, [nan, 1.0]), (4, [inf, 1.0]),
            (5, [None, 1.0]), (6, []), (8, [0.0, 0.0]), (400, [0.0, 0.0]), (9, [1.0]), (500, [5.0]), (None, [1.0, 1.0]), (10, [1e20, -1e20]), (600, [3e38, 3e38])]
    _write(spark, tmp_path, rows)
    found = queries.QUERIES["op11_learned_partitions"](spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got == brute(rows)


def test_no_rows_and_one_row(spark, tmp_path):
    _write(spark, f"{tmp_path}/a", [])
    _write(spark, f"{tmp_path}/b", [(100, [1.0])])
    for d in "ab":
        assert queries.QUERIES["op11_learned_partitions"](spark, f"{tmp_path}/{d}").collect() == []


def test_recall_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    found = queries.QUERIES["op11_learned_partitions"](spark, sf).collect()
    assert _recall(found, brute([tuple(r) for r in table.collect()])) >= 0.9
