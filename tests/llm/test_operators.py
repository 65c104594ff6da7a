"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, no rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkbars.llm import chat, decontaminate, langid, licences, mixing, planes, quality, sharding, simhash, topk
from sparkbars.llm.common import word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus(seed=3, n=160):
    rng = random.Random(seed)
    words = ["ka", "lo", "mi", "Ne", "été", "straße", "x1", "don't", "the", "of"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ".", ",\n"]) for _ in range(rng.randint(3, 60))) for _ in range(n)]
    texts += [None, "", "   \n\t", "one", "one two", texts[0], texts[0], texts[1] + " ka", "a " * 9000, "|".join("xy" * 50 for _ in range(200))]
    rows = [(i, t, "en", rng.choice(["a", "b", "b", None, "é"]), 0) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, "nobody's text", None, None, None)]  # repeated rows, null id


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_word_count(docs):
    for r in docs.select("text", word_count(F.col("text")).alias("n")).collect():
        assert r["n"] == len(words(r["text"]))


# --- mixing

def _targets(sizes: dict, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return stopped | share
        stopped |= {s: 3 * sizes[s] for s in above}


def test_mix_meets_every_budget(docs, corpus):
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    got = mixing.mix(sized).collect()
    assert len(got) == len(corpus)
    sizes = {}
    for _, t, _, s, _ in corpus:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = _targets(sizes)
    for s, target in want.items():
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert all(abs(r["target"] - target) < 1e-6 for r in mine)
        assert sum(r["taken"] for r in mine) == math.floor(mine[0]["target"])
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    key = lambda rows: sorted(map(str, rows))
    assert key(mixing.mix(sized.repartition(9)).collect()) == key(got)
    again = mixing.repeated(mixing.mix(sized), ["doc_id"]).count()
    assert again == sum(r["copies"] for r in got)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(empty).count() == 0
    no_words = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [r["taken"] for r in mixing.mix(no_words).collect()] == [0, 0]


# --- token planes

@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(spark, docs, corpus, bits):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    more = ["hello <|endoftext|> world", "<|endoftext|>", "a <|endoftext|><|endoftext|>\n\n b", "<|endoftext |>"]
    corpus = corpus + [(10_000 + i, text, "en", "a", 0) for i, text in enumerate(more)]
    docs = docs.union(spark.createDataFrame(corpus[-len(more):], DOCS))
    got = planes.read_documents(spark, planes.write_shards(spark, docs, path, bits=bits, shard_bytes=4000)).collect()
    start, want = 0, []
    for i, text in sorted(((r[0], r[1] or "") for r in corpus), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    order = lambda rows: sorted(rows, key=lambda r: r[1])
    assert order(map(tuple, got)) == order(want)


def test_planes_of_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert planes.read_documents(spark, planes.write_shards(spark, empty, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_plane_transposition():
    for dtype in ("<u4", "<i8", "<u8", "u1"):
        x = np.random.default_rng(1).integers(0, 250, 77).astype(dtype)
        for bits in (False, True):
            assert (planes.from_planes(planes.to_planes(x, bits), len(x), x.dtype) == x).all()


def test_encoder_parts_equal_whole_texts():
    e = planes.Encoder(public_tokenizers.path("byte_bpe_50k.json"), plain=True)
    texts = ["", " ", "  a  b", "\t", "\tlead", "\nlead", "x \n y", " lead", "trail ", "it's don't 'tis a'b", "a1b2 3c", "\n\nfoo\n", "a b c", "<|endoftext|> hi",
              "tab\tsep x", "né!?ok... (a) [b]'s", "word.\nNext", "a.b, c's.", "\x1c a", "3.14, 2nd.", "é.\n- x", "\n", "a\n", "'s 's", "x- -y"]
    whole = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for group in (texts, texts, texts[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(group)] == whole[:: 1 if group is texts else -1]
    assert list(e.encode([])) == []


def test_every_letter_of_encoder_by_the_model_alone():
    e = planes.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x41, 0x250) if planes._LETTERS.fullmatch(chr(c))]
    words = letters + ["".join(rng.choices(letters, k=rng.randint(2, 12))) for _ in range(3000)] + ["the", "Straße", "naïve"]
    assert e._letter_ids(words) == [np.array(e.tokenizer.encode(" " + w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]


# --- chat

def test_chat_round_trip(spark):
    hard = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "system", hard), (1, 1, "user", "### x: </turn>\n\\"), (1, 2, "assistant", "\\\\</turn>\n### "), (1, 3, "user", None),
             (1, 4, "assistant", ""), (1, 5, "assistant", "日本 \U0001f600"), (1, 6, "user", "bye"), (2, 0, "user", "only"),
             (3, None, "a: b: ", "z"), (3, 1, None, "y"), (3, 1, "assistant", "t"), (3, 1, "assistant", "t"), (None, 0, "assistant", hard * 500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    examples = chat.expand(df)
    by_conv = {}
    for c, turn, role, text in sorted(turns, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        by_conv.setdefault(c, []).append((role or "", text or ""))
    for r in chat.read_back(examples).collect():
        want = by_conv[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
    rows = examples.collect()
    assert sum(r["loss_end"] > r["loss_start"] or "</turn>" in r["text"] for r in rows) == len(rows)
    for r in rows:  # the mask covers the last turn's text only
        if r["loss_end"] > r["loss_start"]:
            assert r["text"][r["loss_end"]:] == "</turn>\n"
    assert chat.expand(df.limit(0)).count() == 0


# --- decontamination

def _tokens(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _contamination(text, items, window=13):
    w = _tokens(text)
    hit, found = set(), set()
    for i, t in items:
        x = _tokens(t)
        n = min(window, len(x))
        for p in range(len(x) - n + 1 if n else 0):
            for q in range(len(w) - n + 1):
                if w[q : q + n] == x[p : p + n]:
                    hit |= set(range(q, q + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("short", [False, True])
def test_decontamination_against_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3000)
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "γάμμα", "d4", "e", "zeta"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(13, 40))) for i in range(12)] + [(20, None), (21, "..."), (22, items_text := say(30)), (23, items_text)]
    if short:
        items += [(30, "d4 e d4"), (31, "Solo")]
    rows = []
    for i in range(90):
        parts = [" ".join(rng.choice(["un", "deux", "e", "d4", "solo"]) for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.6:
            x = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(x) or 1)
            parts.append(", ".join(x[a : a + rng.randint(10, 40)]).upper() if rng.random() < 0.3 else "-".join(x[a:]))
        parts.append(say(rng.randint(0, 5)))
        rows.append((i, " ".join(parts)))
    rows += [(200, None), (201, ""), (202, items_text + " " + items_text), rows[3], (None, items_text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r[c] for c in ("text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
                  for r in decontaminate.scan(spark, df, tests).collect()), key=str)
    want = []
    for _, t in rows:
        n, hit, found = _contamination(t, items)
        want.append((t, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)  # several blocks of items
    more = sorted((tuple(r[c] for c in ("text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
                   for r in decontaminate.scan(spark, df, tests).collect()), key=str)
    assert more == got
    assert decontaminate.clean(spark, df, tests).count() == sum(not w[-1] for w in want)


def test_longest_match_and_no_items(spark):
    item = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(5, 30)) + " z")], "doc_id long, text string")
    r = decontaminate.scan(spark, df, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert r["longest"].asDict() == {"words": 25, "doc_word": 2, "item_id": "7", "item_word": 5}
    r = decontaminate.scan(spark, df, spark.createDataFrame([], "item_id long, text string")).first()
    assert (r["n_words"], r["n_hit"], r["contaminated"], r["longest"]) == (28, 0, False, None)
    assert decontaminate.scan(spark, df.limit(0), spark.createDataFrame([(7, item)], "item_id long, text string")).count() == 0


def test_a_very_long_item_needs_memory_of_its_words_only(spark):
    import tracemalloc

    rng = random.Random(8)
    item = [f"w{rng.randrange(300)}" for _ in range(12000)]
    docs = [" ".join(item[4000:9000]), "x " + " ".join(item) + " y", "w1 w2", " ".join(item[50:62]), "z " + " ".join(item[70:83])]
    tracemalloc.start()
    block = decontaminate.TestBlock([7, 8], [" ".join(item).encode(), b"w1 w2"], 13)
    n, mask, at, items, longest = decontaminate.scan_shard([d.encode() for d in docs], block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # a matrix of all suffixes has 576 MB
    hits = [int(mask[a : a + k].sum()) for a, k in zip(at, n)]
    short = sum(item[4000:9000][i : i + 2] == ["w1", "w2"] for i in range(4999))
    assert hits[:3] == [5000, 12000, 2] and hits[4] == 13
    assert items[1] >= {0} and items[2] == {1} and (items[0] == {0, 1}) == (short > 0)
    assert {d: longest[d] for d in (0, 1, 4)} == {0: (5000, 0, 0, -4000), 1: (12000, -1, 0, 0), 4: (13, -1, 0, -70)}


# --- sharding

def test_shards_are_even_and_gapless(spark, docs, corpus, monkeypatch):
    for per_range in (64, 2):
        monkeypatch.setattr(sharding, "PER_RANGE", per_range)
        got = sharding.shard(spark, docs.select("doc_id", "text")).collect()
        assert len(got) == len(corpus)
        size = sorted(len((t or "").encode()) + 1 for _, t, *_ in corpus)
        assert sorted(r["size"] for r in got) == size
        assert sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in corpus)
        for s in range(16):
            mine = [r for r in got if r["shard"] == s]
            assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
            assert abs(sum(r["size"] for r in mine) - sum(size) / 16) <= max(size)
    assert sharding.shard(spark, docs.select("doc_id", "text").limit(0)).count() == 0


def test_hot_text_is_subdivided(spark):
    hot = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.repeat(F.lit("y"), (F.col("id") % 50).cast("int"))).alias("text"))
    got = sharding.shard(spark, hot).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 16 and all(r["m"] == r["n"] - 1 for r in got)
    mean = sum(r["b"] for r in got) / 16
    assert all(abs(r["b"] - mean) <= 51 for r in got)


# --- SimHash

def _fingerprint(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, budget=3):
    """{fingerprint: set of all in its component}"""
    fps, groups = sorted(set(fps)), {}
    for f in fps:
        near = [groups[g] for g in list(groups) if (f ^ g).bit_count() <= budget]
        merged = {f}.union(*near)
        for g in merged:
            groups[g] = merged
    return groups


def test_fingerprint(spark, corpus):
    for _, t, *_ in corpus:
        assert simhash.fingerprint(None if t is None else t.encode()) == _fingerprint(t)
    assert spark.range(1).select(F.xxhash64(F.lit("ab cd ef"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("ab cd ef", 42)


@pytest.mark.parametrize("budget, node", [(3, 2048), (3, 6)])
def test_trie_join_against_brute_force(spark, budget, node):
    rng = random.Random(7)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(60):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(rng.randint(0, 12)):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(centre)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << b) ^ (1 << c) for b in range(12) for c in range(12)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = simhash.components(spark, simhash.links(spark, df, budget, node)).collect()
    got = {}
    for r in found:
        got.setdefault(r["root"], set()).add(r["node"])
    want = {frozenset(map(signed, g)) for g in map(frozenset, _components(fps, budget).values()) if len(g) > 1}
    assert {frozenset(g) for g in got.values()} == want
    assert all(root == min(g) for root, g in got.items())


def test_near_duplicates_and_one_of_each(spark, docs, corpus):
    got = simhash.near_duplicates(spark, docs.select("doc_id", "text")).collect()
    groups = _components([_fingerprint(r[1]) for r in corpus])
    least = {}
    for i, t, *_ in corpus:
        root = min(groups[_fingerprint(t)])
        least[root] = min(x for x in (least.get(root), i) if x is not None) if i is not None or root in least and least[root] is not None else least.get(root)
    want = sorted(((i, least[min(groups[_fingerprint(t)])]) for i, t, *_ in corpus), key=str)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == want
    kept = simhash.one_of_each(spark, docs).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted(least.values(), key=str)
    assert set(kept[0].asDict()) == set(docs.columns)
    assert simhash.one_of_each(spark, docs.limit(0)).count() == 0


# --- top-k

def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 12).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 12) for i in range(60)]  # ties
    rows += [(600, None), (620, [float("nan")] * 12), (640, [None] + [0.1] * 11), (660, [float("inf")] + [0.0] * 11), (680, []), (700, [0.0] * 12), (720, [0.25] * 5)]
    df = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.search(spark, df, df.filter("vec_id % 20 = 0"), k=20, block=64, query_block=8)
    whole = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(64 * float(np.float32(x))) for x in v]
    want = []
    for q in whole:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
            want += [(q, k + 1, i, -score) for k, (score, i) in enumerate(s)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(spark, df.limit(0), df.limit(0)).count() == 0
    assert topk.search(spark, df.filter("vec_id = 20"), df.filter("vec_id = 20")).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(0, 5, (5000, 4)))
    v[17] = [60, 60, 60, 60]
    lists = np.argsort(v, axis=0, kind="stable")
    steps = np.unique(np.minimum([16 << i for i in range(12)], 5000))
    ids, scores, depth = topk.threshold_search(np.arange(5000), v, lists, steps, -1, np.array([3.0, 2.0, 1.0, 1.0]), 1)
    assert ids.tolist() == [17] and scores[0] == 420 and depth < 5000


# --- quality and language

def _labelled(spark, n=400):
    rng = random.Random(11)
    syllables = ["ra", "ten", "lo", "mi", "est", "or"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        good = i % 4 != 0
        n_words = rng.randint(8, 80)
        bad = [lambda: word() + rng.choice(["%%%", "***", "###"]), lambda: word().upper() + "!!"][i % 8 == 0]
        once = word()
        text = " ".join(word() if good else bad() for _ in range(n_words)) if i % 12 else " ".join([once] * n_words)
        rows.append((i, text, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)


def test_quality_is_learned(spark):
    df = _labelled(spark)
    labels = df.select("doc_id", "quality").union(spark.createDataFrame([(1, None), (None, 1), (9999, 0)], "doc_id long, quality int"))
    model = quality.fit(spark, df.select("doc_id", "text"), labels)
    more = df.union(spark.createDataFrame([(None, None, 1), (5001, "", 1), (5002, " ", 1), (5003, "ra " * 200000, 1)], df.schema))
    got = quality.score(spark, more, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert len(got) == more.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in held]) > 0.95
    nothing = quality.fit(spark, df.select("doc_id", "text").limit(0), labels.limit(0))
    assert quality.score(spark, df.limit(0), nothing).count() == 0


def test_features_do_not_depend_on_company():
    a, b = "Some words, some wörds some some", "x"
    alone = [np.sort(quality.features([t])[0]) for t in (a, b, "")]
    ids, doc = quality.features([a, b, "", a])
    for k, t in enumerate((0, 1, 2, 0)):
        assert (np.sort(ids[doc == k]) == alone[t]).all()


def test_language_is_learned(spark):
    rng = random.Random(13)
    letters = {"aa": "aeiknt", "bb": "oursld", "cc": "ñóvwzy"}
    rows = []
    for i in range(240):
        lang = list(letters)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7))) for _ in range(40)), lang))
    df = spark.createDataFrame(rows + [(900, "abc", None)], "doc_id long, text string, lang string")
    profiles = langid.fit(spark, df)
    assert profiles.langs == ["aa", "bb", "cc"]
    more = df.union(spark.createDataFrame([(901, None, None), (902, "", None), (903, "12 !! 34", None), (904, "ñóv " * 400000, None)], df.schema))
    got = {r["doc_id"]: r for r in langid.predict(spark, more.select("doc_id", "text"), profiles).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (901, 902, 903, 904)] == ["und", "und", "und", "cc"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.fit(spark, df.limit(0))
    assert langid.predict(spark, df.select("doc_id", "text"), none).first()["lang_pred"] == "und"


def test_grams():
    keys, counts = langid.grams("Ab, b!")
    pack = lambda s: sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    want = {"a": 1, "b": 2, " a": 1, "ab": 1, "b ": 2, " b": 1, " ab": 1, "ab ": 1, " b ": 1}
    assert dict(zip(keys.tolist(), counts.tolist())) == {pack(s): n for s, n in want.items()}


# --- licences

def test_licence_families(spark):
    rng = random.Random(17)
    plain = lambda n: " ".join(rng.choice(["the", "of", "green", "river", "stone", "walks"]) for _ in range(n))
    rows = [(i, "\n".join(plain(12) for _ in range(4))) for i in range(120)]
    said = {200: ("MIT", "Released under the MIT License."), 201: ("GPL", "This work is licensed under the GNU General Public License, version 3."),
            202: ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), 203: ("CC-BY-NC", "Licensed under CC BY-NC 4.0.")}
    rows += [(i, plain(20) + "\n" + notice + "\n" + plain(9)) for i, (_, notice) in said.items()]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, plain(30000)), (304, "All rights reserved. The license fee is due."), rows[0], (None, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in licences.by_document(df, licences.fit(spark, df).scan(df)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for i, r in got.items():
        want = said[i][0] if i in said else "MIT" if i is None else None
        assert r["family"] == want and r["families"] == ([want] if want else []), (i, r)
