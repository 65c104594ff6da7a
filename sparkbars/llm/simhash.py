"""SimHash near-duplicates: fingerprints, a binary-trie self-join over the
distinct ones, and connected components of the links.

Two fingerprints within k bits agree on at least one of k + 1 blocks of bits.
For each block the fingerprints are rotated so that it comes first, and grouped
by it: a group is one node of the trie over the rotated fingerprints, paired
with itself at no differing bit. From there node pairs are descended together
bit by bit; children that part add a differing bit, and a pair beyond the
budget is dropped with all below it. A large node is dealt out as the pairs of
parts of its members, so that its work is spread over tasks. A task writes only
the links of a spanning forest of what it found: the components are those of
all links, and the rows stay in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, written

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Members of a trie node that are kept together; larger nodes are dealt out in parts.
NODE = 2048
#: Rows of node pairs that one group of a task holds, on average.
UNIT_ROWS = 8192
#: Node pairs descended at once in a task.
FRONTIER = 1 << 17
#: Pairs of nodes with so many member pairs are leaves: compared directly.
LEAF = 4


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of UTF-8 text, repeats included (no words: 0)."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and runs of ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for at in range(0, n, 65536):  # bounded memory for very long texts
        part = words[at : at + 65536 + shingle - 1]
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*[part[i:] for i in range(shingle)]))]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, fp: str = "fp", text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the fingerprint ``fp`` as a long (its 64 bits)."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps.view(np.int64))], names=[*keep, fp])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), f"`{fp}` bigint"])
    return docs.mapInArrow(run, schema)


def trie_pairs(values: np.ndarray, a0, a1, b0, b1, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, whose values differ in ``budget`` bits or fewer.

    Each of the node pairs [a0, a1) x [b0, b1) shares its first ``depth`` bits;
    the values of a range are sorted and distinct, and a node is paired with
    itself or with one that lies wholly behind it.
    """
    stack = [(depth, np.zeros(len(a0), np.int64), a0, a1, b0, b1)]
    while stack:
        d, err, a0, a1, b0, b1 = stack.pop()
        if len(err) > FRONTIER:
            half = len(err) // 2
            stack += [(d, *(x[half:] for x in (err, a0, a1, b0, b1))), (d, *(x[:half] for x in (err, a0, a1, b0, b1)))]
            continue
        leaf = (a1 - a0) * (b1 - b0) <= LEAF
        if d == 64:
            leaf[:] = True
        if leaf.any():
            i, j = _member_pairs(a0[leaf], a1[leaf], b0[leaf], b1[leaf])
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            err, a0, a1, b0, b1 = (x[~leaf] for x in (err, a0, a1, b0, b1))
        if not len(err):
            continue
        itself, am, bm = a0 == b0, _parted(values, a0, a1, d), _parted(values, b0, b1, d)
        free = err < budget
        kids = [(a0, am, b0, bm, err, True), (am, a1, bm, b1, err, True),
                (a0, am, bm, b1, err + 1, free), (am, a1, b0, bm, err + 1, free & ~itself)]
        kept = [((x1 > x0) & (y1 > y0) & ok) for x0, x1, y0, y1, _, ok in kids]
        a0, a1, b0, b1, err = (np.concatenate([kid[c][k] for kid, k in zip(kids, kept)]) for c in range(5))
        if len(err):
            stack.append((d + 1, err, a0, a1, b0, b1))


def _parted(values: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Where bit ``depth`` (from the top) turns from 0 to 1 in each sorted range, by binary search."""
    bit, lo, hi = np.uint64(63 - depth), start.copy(), end.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        zero = ((values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1)) == 0
        lo, hi = np.where(open_ & zero, mid + 1, lo), np.where(open_ & ~zero, mid, hi)
    return lo


def _member_pairs(a0, a1, b0, b1):
    """Positions (i, j) of all members of the given node pairs."""
    n = (a1 - a0) * (b1 - b0)
    k = np.repeat(np.arange(len(n)), n)
    at, width = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n), (b1 - b0)[k]
    return a0[k] + at // width, b0[k] + at % width


class _Forest:
    """Union-find over positions that keeps only the links which joined two trees."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            new = a != b
            if not new.any():
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            _, first = np.unique(hi, return_index=True)  # each tree is hung under a smaller one once: no cycle
            self.root[hi[first]] = lo[first]
            self.links.append((i[first], j[first]))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of budget + 1 blocks that cover the 64 bits."""
    edge = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def _rotated(fp: np.ndarray, bits: int) -> np.ndarray:
    """To the left."""
    return (fp << np.uint64(bits)) | (fp >> np.uint64(64 - bits)) if bits % 64 else fp


def _join_nodes(budget: int):
    blocks = _blocks(budget)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((2, 0), np.uint64)]
        for block, g in rows.groupby("block"):
            at, bits = blocks[int(block)]
            values = _rotated(g["fp"].to_numpy().view(np.uint64), at)
            keys = [g[c].to_numpy() for c in ("node", "part_a", "part_b", "side")]
            order = np.lexsort((values, *keys[::-1]))
            values, keys = values[order], [k[order] for k in keys]
            turns = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            ends, own = np.r_[turns[1:], len(values)], keys[1][turns] == keys[2][turns]
            first = np.flatnonzero(own | (keys[3][turns] == 0))
            # the other side of a pair of parts is the range behind it, if that has members
            other = np.where(own[first], first, np.minimum(first + 1, len(turns) - 1))
            paired = own[first] | ((first + 1 < len(turns)) & (keys[3][turns[other]] == 1) & np.all(
                [k[turns[first]] == k[turns[other]] for k in keys[:3]], axis=0))
            a, b = first[paired], other[paired]
            forest = _Forest(len(values))
            for i, j in trie_pairs(values, turns[a], ends[a], turns[b], ends[b], bits, budget):
                forest.add(i, j)
            found += [_rotated(np.stack([values[i], values[j]]), 64 - at) for i, j in forest.links]
        pairs = np.concatenate(found, axis=1).view(np.int64)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    return run


def links(spark: SparkSession, distinct: DataFrame, budget: int = MAX_BITS, node: int = NODE) -> DataFrame:
    """(fp) distinct -> links ``a, b`` that connect whatever lies within ``budget`` bits."""
    def rotated(at: int):
        return F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at)) if at else F.col("fp")

    blocks = _blocks(budget)
    units = max(1, distinct.count() * len(blocks) // UNIT_ROWS)
    members = checkpointed(spark, distinct.select("fp", F.inline(F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(rotated(at), 64 - bits).alias("node"))
        for k, (at, bits) in enumerate(blocks)]))))
    parts = checkpointed(spark, members.groupBy("block", "node").agg(F.ceil(F.count("*") / node).cast("int").alias("parts"), F.count("*").alias("n"))
                         .filter("n > 1").drop("n"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(
        F.least("part", p).alias("part_a"), F.greatest("part", p).alias("part_b"), F.when(F.col("part") <= p, 0).otherwise(1).alias("side")))
    dealt = (members.join(parts, ["block", "node"]).withColumn("part", part)
             .select("fp", "block", "node", F.inline(pairs))
             .withColumn("unit", F.pmod(F.xxhash64("block", "node", "part_a", "part_b"), F.lit(units))))
    return dealt.groupBy("unit").applyInPandas(_join_nodes(budget), "a bigint, b bigint")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(a, b) -> ``node, root``: the smallest node of the component of each node
    that has a link, by rounds of large-star and small-star."""
    e = checkpointed(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    if e.isEmpty():
        return e.toDF("node", "root")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpointed(spark, both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = checkpointed(spark, large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(spark, small.union(low).filter("u != v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.toDF("node", "root").union(e.select("v", "v").distinct())
        state = now


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, budget: int = MAX_BITS) -> DataFrame:
    """(doc_id, ..., text) -> the same without text, with ``fp``, ``root`` (a
    fingerprint that names the component) and ``component_id``: the smallest
    doc_id reachable over links; null ids are passed over, so it is null only
    in a component that has no other. Null and empty texts have fingerprint 0
    and link like any other; repeated rows are copies. No rows: no rows."""
    rows = checkpointed(spark, fingerprints(docs, shingle))
    distinct = checkpointed(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(spark, links(spark, distinct.select("fp"), budget)).withColumnRenamed("node", "fp")
    of = checkpointed(spark, distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = checkpointed(spark, of.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = checkpointed(spark, of.join(least, "root").select("fp", "root", "component_id"))
    return rows.join(ids, "fp").select(*[c for c in rows.columns if c != "fp"], "fp", "root", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the
    smallest id (null ids last), of several such rows the one whose text has
    the smallest hash, then the first of the table. Rows are told apart by
    their number in the table written here, never by a hash, and other columns
    may have any type."""
    rows = written(spark, docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc")), "numbered")
    keys = rows.select("_doc.doc_id", "_row", F.xxhash64("_doc.text").alias("_hash"), "_doc.text")
    found = near_duplicates(spark, keys, **how)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_hash", "_row")).alias("first")
    best = checkpointed(spark, found.groupBy("root").agg(first).select("first._row"))
    return rows.join(best, "_row", "left_semi").select("_doc.*")
