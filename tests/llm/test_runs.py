"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from sparkbars.llm import queries, runs


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                s, e = i, j + q
                if e - s >= max(6, 4 * q) and all(any(words[t] != words[t + p] for t in range(s, e - p)) for p in range(1, q)):
                    out.append((s, e - s, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _random(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 40]), rng.randint(0, 130)
    if rng.random() < 0.4:
        return [b"w%d" % rng.randrange(k) for _ in range(n)]
    w = []
    while len(w) < n:
        part = [b"w%d" % rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 13]))]
        w += (part * rng.randint(1, 9))[: rng.randint(1, 80)]
        if rng.random() < 0.3:
            w += w[-rng.randint(1, 30):]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_random_words(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = [_random(rng) for _ in range(rng.randint(1, 6))]
        for words, (found, collapsed) in zip(docs, runs._batch([b" ".join(d) or None for d in docs])):
            want = brute(words)
            assert [(r["start"], r["length"], r["period"]) for r in found] == want
            drop = {i for s, k, q in want for i in range(s + q, s + k)}
            assert collapsed == b" ".join(w for i, w in enumerate(words) if i not in drop)


def test_long_periods_and_shared_grammar():
    rng = random.Random(9)
    part = [b"p%d" % rng.randrange(50) for _ in range(3000)]
    docs = [part * 4 + part[:17], part * 5, [b"a"] * 20000, part * 3, part[1:] + part * 4]
    found = [[(r["start"], r["length"], r["period"]) for r in f] for f, _ in runs._batch([b" ".join(d) for d in docs])]
    assert (0, 12017, 3000) in found[0] and (0, 15000, 3000) in found[1] and found[2] == [(0, 20000, 1)]
    assert not any(q == 3000 for _, _, q in found[3]) and any(q == 3000 and k >= 14999 for _, k, q in found[4])


def test_grammar_expands_to_the_text():
    import numpy as np

    x = np.array(([1, 2, 3, 1, 2, 4] * 30 + [5] * 50) * 3)
    g = runs.Grammar(x, np.array([0, 100]))
    for place, symbol in zip(g.places, g.symbols):
        first = g.first[symbol]
        assert (x[place : place + g.size[symbol]] == x[first : first + g.size[symbol]]).all()
        assert not place < 100 < place + g.size[symbol]  # never across documents
    assert g.lengths.sum() == len(x) and len(g.rest) < len(x) / 4


def test_query(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(w.decode() for w in _random(rng)) for _ in range(160)]
    texts += [None, "", " \n\t ", "one", "a b \x85 a b", "na " * 30, "été\n" * 9 + "fin", "x y " * 40000]
    rows = [(i, t, "en", "collapsed", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, "la la la la la la", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, runs string, best long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute(words) if n < 1000 else [(0, n, 2)]
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        drop = {i for s, k, q in found for i in range(s + q, s + k)}
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        want.append((doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect() == []
