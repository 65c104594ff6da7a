"""Token alignment against brute force on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkbars.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    of_char = align.byte_alphabet()
    a_bytes = lambda i: bytes(of_char[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def brute(text, tokenizers):
    """(groups text, n_a, n_b, list of linked pairs) of whole encodings."""
    a, b, a_bytes, b_bytes = tokenizers
    if not text:
        return "", 0, 0, []
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba, bb = [a_bytes(i) for i in ia], [b_bytes(i) for i in ib]
    if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
        return "", 0, 0, []
    spans = []
    for ids, parts in ((ia, ba), (ib, bb)):
        at, of = 0, []
        for i, p in zip(ids, parts):
            of.append((at, at + len(p), i))
            at += len(p)
        spans.append(of)
    ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, lo = [], 0
    for hi in ends:
        groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s < hi) for side in spans))
        lo = hi
    j, links = 0, []
    for s, e, i in spans[0]:
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((i, spans[1][k][2]))
            k += 1
    return ";".join(groups), len(ia), len(ib), links


def _texts(seed=4, n=120):
    rng = random.Random(seed)
    words = ["the", "Straße", "naïve", "x1", "don't", "...", "été", "漢字", "🙂", "https://a.b/c", "<s>", "<|endoftext|>", "<0x41>", "aaaa", "ünïcödé", "ka"]
    seps = [" "] * 12 + ["\n", "\n\n", "  ", " \n", "\n ", "\t", "\r\n", "\n\n\n", "\xa0", "\x1c", "  ", " \t ", "\x0b"]
    texts = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(1, 40)))
        texts.append(rng.choice(["", " ", "\n", "  ", "\n\n"]) + t if rng.random() < 0.3 else t)
    texts += [None, "", " ", "  ", "\n", "a▁b", "ﬁ é ｈ", "a\x00b", "x", "one two", "one two", "z" * 700, "word " * 300, "漢" * 500, "á b " * 90, "\r\n" * 40]
    return texts


def test_whole_texts(tokenizers):
    texts = _texts(n=300)
    aligner = align.Aligner(A, B)
    for text, (n_a, n_b, n_groups, n_links, groups, pairs, times) in zip(texts, aligner.whole(texts)):
        want, wa, wb, links = brute(text, tokenizers)
        assert (groups, n_a, n_b, n_links) == (want, wa, wb, len(links)), repr(text)
        assert n_groups == (want.count(";") + 1 if want else 0)
        assert dict(zip(pairs.tolist(), times.tolist())) == Counter(i << 32 | j for i, j in links)


@pytest.mark.parametrize("chunk", [1, 7, 40, 4096])
def test_fragments_are_a_monoid(chunk, tokenizers):
    rng, aligner = random.Random(chunk), align.Aligner(A, B)
    for text in filter(None, _texts(seed=chunk, n=40)):
        parts = [aligner.fragment(*r) for r in aligner.ranges(text, chunk)]
        while len(parts) > 1:  # any order of composition
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [aligner.compose(parts[i], parts[i + 1])]
        f, (want, n_a, n_b, links) = parts[0], brute(text, tokenizers)
        groups = align.Groups() if f.bad else f.groups.plus(aligner.closed(*f.suffix))
        assert groups.text == want, repr(text)
        if want:
            assert (f.n_a, f.n_b) == (n_a, n_b) and not len(f.prefix[0])
            assert dict(zip(groups.pairs.tolist(), groups.times.tolist())) == Counter(i << 32 | j for i, j in links)


def _expected(rows, tokenizers):
    found = [(doc_id, *brute(text, tokenizers)) for doc_id, text in rows]
    docs = Counter(p for *_, links in found for p in set(links))
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    return sorted(((d, n_a, n_b, g.count(";") + 1 if g else 0, len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for d, g, n_a, n_b, links in found), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query(spark, tmp_path, tokenizers, monkeypatch):
    monkeypatch.setattr(align.align, "__defaults__", (300, 3))  # most texts in ranges, several levels
    texts = _texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "nobody's text"), (7, "word " * 900)]
    spark.createDataFrame([(*r, "groups", 1) for r in rows], "doc_id long, text string, pairs string, row long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_token_alignment"](spark, str(tmp_path)).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == _expected(rows, tokenizers)


def test_joined_counts_are_the_same(spark, tokenizers):
    from pyspark.sql import functions as F

    from sparkbars.llm.common import written

    rows = [(i, t) for i, t in enumerate(_texts(seed=8, n=60))]
    found = align.align(spark, spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    found = written(spark, found.drop("groups").withColumn("row", F.monotonically_increasing_id()), "t")
    one, two = (sorted(map(tuple, align.weigh(spark, found, k).select(*COLUMNS[:-1]).collect())) for k in (1 << 40, 0))
    assert one == two == sorted(r[:-1] for r in _expected(rows, tokenizers))


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect() == []
