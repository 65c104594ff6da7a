"""Periodic runs of words, found over a grammar.

A batch of documents is one sequence of word ids. Re-Pair shortens it: in every
round the pairs that occur most often, and more often than the pairs they
overlap with, become nonterminals, until hardly a pair occurs twice. A run that
lies in a text lies in some node of its derivation: either it crosses the
boundary between the two halves of a nonterminal, or a boundary between symbols
that are left. So the runs that cross a nonterminal's boundary are computed
once, at one of its places, and translated to all others; the boundaries that
are left are computed where they are; intervals of one period that share at
least a period are merged to maximal ones.

A run of four periods that crosses a boundary holds two whole periods on one
side of it, a square that starts or ends there. For periods in [c, 2c), c a
power of two, the square's c words at the boundary occur again one period on:
these places come from the ranks of c-grams (prefix doubling, which only goes on
with grams that their document repeats). Equal ranks of two overlapping c-grams
confirm the square exactly; then its interval is extended word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of documents that share a grammar (a longer document has its own).
BATCH_WORDS = 1 << 19
#: Rounds end when they would replace fewer than this share of the symbols.
LEAST_SHARE = 0.005
#: Buckets in which pairs are counted, at most; a shared bucket only changes the order of replacement.
PAIR_BUCKETS = 1 << 22


class Grammar:
    """Re-Pair over ``x``, whose documents begin at ``starts``.

    ``left``, ``size`` and ``first`` have one entry per nonterminal: words of
    its left half, of the whole, and its first place. ``places`` and ``symbols``
    list all its derivation positions. ``rest`` are the places of the symbols
    that are left, ``lengths`` their words."""

    def __init__(self, x: np.ndarray, starts: np.ndarray):
        self.rules: dict[int, int] = {}
        n_words = int(x.max(initial=-1)) + 1
        head = np.zeros(len(x) + 1, bool)
        head[starts[starts < len(x)]] = True
        seq, at, length = x.astype(np.int64), np.arange(len(x)), np.ones(len(x), np.int64)
        left, size, first, places, symbols = [], [], [], [], []
        while len(seq) > 1:
            taken = self._round(seq, head[at[1:]])
            if len(taken) < max(2, LEAST_SHARE * len(seq)):
                break
            pairs, one, inverse, counts = np.unique(seq[taken] << 32 | seq[taken + 1], return_index=True, return_inverse=True, return_counts=True)
            known = np.fromiter((k in self.rules for k in pairs.tolist()), bool, len(pairs))
            worth = (counts > 1) | known
            keep = worth[inverse]
            if keep.sum() < max(2, LEAST_SHARE * len(seq)):
                break
            had = len(self.rules)
            ids = np.full(len(pairs), -1, np.int64)
            ids[worth] = [self.rules.setdefault(k, len(self.rules)) for k in pairs[worth].tolist()]
            new = np.flatnonzero(ids >= had)  # in ascending order of their numbers
            left.append(length[taken[one[new]]])
            size.append(length[taken[one[new]]] + length[taken[one[new]] + 1])
            first.append(at[taken[one[new]]])
            taken, inverse = taken[keep], inverse[keep]
            places.append(at[taken])
            symbols.append(ids[inverse])
            seq[taken] = n_words + ids[inverse]
            length[taken] += length[taken + 1]
            stay = np.ones(len(seq), bool)
            stay[taken + 1] = False
            seq, at, length = seq[stay], at[stay], length[stay]
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.left, self.size, self.first = join(left), join(size), join(first)
        self.places, self.symbols = join(places), join(symbols)
        self.rest, self.lengths = at, length

    @staticmethod
    def _round(seq: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Places of the pairs to replace: more frequent than those beside them
        (ties by their hash); of a pair that overlaps itself every second."""
        with np.errstate(over="ignore"):
            hashed = (seq[:-1] * np.int64(-7046029254386353131) + seq[1:]) * np.int64(-4417276706812531889)
        hashed = (hashed >> 20) & ((1 << 40) - 1)
        bucket = hashed & (min(PAIR_BUCKETS, 4 << len(seq).bit_length()) - 1)
        rank = np.where(begins, -1, np.bincount(bucket, minlength=1)[bucket])
        rank[rank < 2] = -1
        rank = np.where(rank < 0, -1, (np.minimum(rank, 1 << 22) << 40) | hashed)
        new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (rank[1:] < 0)])
        group = np.flatnonzero(new)
        best = rank[group]
        beside = np.concatenate([[-1], best, [-1]])
        wins = (best >= 0) & (best > beside[:-2]) & (best > beside[2:])
        which = np.cumsum(new) - 1
        at = np.flatnonzero(wins[which])
        return at[(at - group[which[at]]) % 2 == 0]


def _squares(gram: np.ndarray, order: np.ndarray, at: np.ndarray, room: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``at``, period) of squares with periods in [c, 2c) that begin
    at the places ``at`` and end within ``room``.

    ``order``: places whose c-gram occurs again, by gram and place. A place's
    later occurrences are followed one by one; a dense progression of them is a
    stretch of one small period, in which a longer primitive period can only
    lead to where as much of the stretch lies ahead as at the place itself."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    asked = np.flatnonzero((room >= 2 * c) & (gram[np.minimum(at, len(gram) - 1)] >= 0) & (at < len(gram)))
    if not len(asked) or len(order) < 2:
        return none
    rank = np.full(len(gram), -1, np.int64)
    rank[order] = np.arange(len(order))
    far = np.int64(1) << 40
    gap = np.append(np.where(gram[order[1:]] == gram[order[:-1]], order[1:] - order[:-1], far), far)
    k0 = rank[at[asked]]
    near = gap[k0] < 2 * c
    asked, k0 = asked[near], k0[near]
    if not len(asked):
        return none
    change = np.flatnonzero(np.append(gap[1:] != gap[:-1], True))
    last = lambda k: change[np.searchsorted(change, k)] + 1  # noqa: E731  end of the progression from k
    dense = lambda k: 4 * gap[k] <= c
    ahead = np.where(dense(k0), last(k0) - k0, 0)
    k, found = k0.copy(), []
    while len(asked):
        jump = dense(k)
        after = np.where(jump, last(k), k + 1)
        test = np.where(jump, after - ahead, after)
        q = np.where(test > k, order[np.minimum(np.maximum(test, 0), len(order) - 1)] - at[asked], 0)
        ok = (q >= c) & (q < 2 * c) & (2 * q <= room[asked])
        i, p = at[asked[ok]], q[ok]
        same = gram[i + p - c] == gram[i + 2 * p - c]  # neither is -1: the first c-gram occurs again
        same &= gram[i + p - c] >= 0
        found.append((asked[ok][same], p[same]))
        k = after
        more = (order[np.minimum(k, len(order) - 1)] + np.minimum(gap[np.minimum(k, len(order) - 1)], far) - at[asked]) < 2 * c
        asked, k, ahead = asked[more], k[more], ahead[more]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _grams(x: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """c, ranks of the c-grams (-1: not repeated in its document), places by rank;
    c = 1, 2, 4 ... as long as a run of such periods could fit.

    ``ends``: for each word the end of its document."""
    n, c = len(x), 1
    key, alive = ends * (int(x.max(initial=0)) + 1) + x, np.arange(n)
    longest = int((ends - np.concatenate([[0], ends[:-1]])).max(initial=0))
    while len(alive):
        by = np.argsort(key, kind="stable")
        key, order = key[by], alive[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        again = np.bincount(group)[group] > 1
        gram = np.full(n, -1, np.int64)
        gram[order[again]] = group[again]
        order = order[again]
        yield c, gram, order
        if 8 * c > longest:
            return
        alive = np.sort(order)
        alive = alive[alive + 2 * c <= ends[alive]]
        alive = alive[gram[alive + c] >= 0]
        key = gram[alive] * (len(group) + 1) + gram[alive + c]
        c *= 2


def _extent(x: np.ndarray, at: int, q: int, lo: int, hi: int) -> tuple[int, int]:
    """The interval of period q around x[at : at + 2q] within [lo, hi)."""
    end, step = at + q, 32
    while end + q < hi:
        to = min(end + step, hi - q)
        same = x[end:to] == x[end + q : to + q]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = to, 4 * step
    start, step = at, 32
    while start > lo:
        to = max(start - step, lo)
        same = (x[to:start] == x[to + q : start + q])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, step = to, 4 * step
    return start, min(end + q, hi)


def _primitive(x: np.ndarray, start: int, end: int, q: int) -> bool:
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            p = q // f
            if np.array_equal(x[start : end - p], x[start + p : end]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def runs(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``x`` that no word beside them
    extends, by start and period; documents begin at ``starts``."""
    n = len(x)
    if n < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    starts = np.unique(starts[starts < n])
    bounds = np.append(starts, n)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    begins = np.repeat(starts, np.diff(bounds))
    g = Grammar(x, starts)
    # boundaries: of nonterminals at their first place, then of the symbols left
    inner = g.rest[1:][begins[g.rest[1:]] != g.rest[1:]]
    lo = np.concatenate([g.first, begins[inner]])
    cut = np.concatenate([g.first + g.left, inner])
    hi = np.concatenate([g.first + g.size, ends[inner]])
    rule = np.concatenate([np.arange(len(g.first)), np.full(len(inner), -1)])
    wide = hi - lo >= LEAST_WORDS
    lo, cut, hi, rule = lo[wide], cut[wide], hi[wide], rule[wide]
    found: set[tuple[int, int, int, int]] = set()  # nonterminal or -1, start (in it), end, period
    widest = int((hi - lo).max(initial=0))
    for c, gram, order in _grams(x, ends):
        if LEAST_PERIODS * c > widest:
            break
        node, period = _squares(gram, order, cut, hi - cut, c)
        begin = cut[node]
        back = gram[: n - c + 1][::-1]  # the same from right to left
        node2, period2 = _squares(back, (n - c - order)[::-1], n - cut, cut - lo, c)
        node, begin, period = np.concatenate([node, node2]), np.concatenate([begin, cut[node2] - 2 * period2]), np.concatenate([period, period2])
        last: dict[int, tuple[int, int]] = {}
        by = np.argsort(begin, kind="stable")
        for i, b, q in zip(node[by].tolist(), begin[by].tolist(), period[by].tolist()):
            if rule[i] < 0:
                s, e = last.get(q, (0, 0))
                if s <= b and b + 2 * q <= e:
                    continue  # of the run met before
            s, e = _extent(x, b, q, int(lo[i]), int(hi[i]))
            if rule[i] < 0:
                last[q] = s, e
            if e - s >= max(LEAST_WORDS, LEAST_PERIODS * q):
                off = int(lo[i]) if rule[i] >= 0 else 0
                found.add((int(rule[i]), s - off, e - off, q))
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.array(sorted(found), np.int64)
    # translate to all derivation positions
    by = np.argsort(g.symbols, kind="stable")
    symbols, places = g.symbols[by], g.places[by]
    from_, to = np.searchsorted(symbols, rows[:, 0]), np.searchsorted(symbols, rows[:, 0], side="right")
    here = rows[:, 0] < 0
    times = np.where(here, 1, to - from_)
    row = np.repeat(np.arange(len(rows)), times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    base = np.zeros(len(row), np.int64)
    moved = ~here[row]
    base[moved] = places[from_[row[moved]] + nth[moved]]
    start, end, period = rows[row, 1] + base, rows[row, 2] + base, rows[row, 3]
    # merge what shares a period
    by = np.lexsort((start, period))
    start, end, period = start[by], end[by], period[by]
    kind = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]])) * (n + 1)
    reach = np.maximum.accumulate(end + kind)
    new = np.concatenate([[True], (start + kind)[1:] > reach[:-1] - period[1:]])
    head = np.flatnonzero(new)
    merged = zip(start[head].tolist(), np.maximum.reduceat(end, head).tolist(), period[head].tolist())
    kept = sorted((s, q, e) for s, e, q in merged if _primitive(x, s, e, q))
    return np.array([(s, e - s, q) for s, q, e in kept], np.int64).reshape(-1, 3)


def _batch(texts: list[bytes | None]) -> Iterator[tuple[list, bytes]]:
    """(runs, words that stay joined by a space) of each text."""
    words = [t.split() if t else [] for t in texts]  # of bytes: runs of anything but ASCII white space
    flat = [w for of_text in words for w in of_text]
    counts = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(counts) - counts
    x = np.asarray(pa.array(flat, pa.binary()).dictionary_encode().indices) if flat else np.zeros(0, np.int32)
    rows = runs(x, starts[counts > 0])
    first = np.searchsorted(rows[:, 0], np.append(starts, len(x)))
    for i, of_text in enumerate(words):
        mine = rows[first[i] : first[i + 1]] - [starts[i], 0, 0]
        if counts[i] and len(mine):
            edge = np.zeros(counts[i] + 1, np.int64)
            np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
            np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
            stays = np.cumsum(edge)[:-1] == 0
            of_text = [w for w, s in zip(of_text, stays.tolist()) if s]
        yield [{"start": s, "length": k, "period": q} for s, k, q in mine.tolist()] if counts[i] else [], b" ".join(of_text)


SCHEMA = "array<struct<start: bigint, length: bigint, period: bigint>>"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> ``doc_id, runs, collapsed``, one row per row.

    ``runs``: all stretches of consecutive words of a smallest period q, at least
    LEAST_WORDS and LEAST_PERIODS * q long, that no neighbouring word extends, as
    (start, length, period) by start and period, words numbered from 0.
    ``collapsed``: the words outside what any run repeats after its first period,
    joined by one space. Null, empty and blank texts have no runs and an empty
    text; repeated rows each have their row; doc_id may be null and of any type;
    other columns are left out. One text is held by one task, at about a hundred
    bytes of memory for a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            group = (np.cumsum(sizes) - sizes) // (BATCH_WORDS * 6)
            cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [len(sizes)]
            for lo, hi in zip(cuts, cuts[1:]):
                found = list(_batch(texts.slice(lo, hi - lo).to_pylist()))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array([f[0] for f in found], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    pa.array([f[1] for f in found], pa.binary()).cast(pa.string()),
                ], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs {SCHEMA}, collapsed string")
