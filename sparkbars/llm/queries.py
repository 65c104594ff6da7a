"""The registered queries of this subpackage, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import align, chat, decontaminate, langid, licences, mixing, neighbours, planes, quality, runs, sharding, simhash, topk
from .common import WORD, checkpointed, read_table, word_count, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


MIX_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, source,
                  ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS i,
             sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
g AS (SELECT min(i) AS first FROM f WHERE l::DOUBLE * w / r <= cap),
t AS (SELECT f.source, f.source_size, CASE WHEN f.i < g.first THEN f.cap::DOUBLE ELSE x.l::DOUBLE * f.w / x.r END AS target
      FROM f, g, f AS x WHERE x.i = g.first),
p AS (SELECT d.*, t.source_size, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + least(greatest(floor(target)::BIGINT - whole * source_size - before, 0), size))::BIGINT AS taken
FROM e
"""


@query("op1_mix_sources", MIX_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weight takes from every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    docs = checkpointed(spark, docs)
    return mixing.mix(docs, "size").select("doc_id", "size", "source_size", "target", "taken")


@query("op2_token_planes")
def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as plane-shuffled shards and read back."""
    return token_planes(spark, read_table(spark, sf_dir, "documents"))


def token_planes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return planes.read_documents(spark, planes.write_shards(spark, docs, public_tokenizers.path("byte_bpe_50k.json")))


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ') AS body,
             replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# '), ': ', ':\ ') AS head FROM c),
n AS (SELECT *, 4 + length(head) + 2 + length(body) + 8 AS chars,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i FROM e),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""


@query("op3_chat_examples", CHAT_SQL)
def op3_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat examples by prefix-target expansion, written and read back, as digests per conversation."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    examples = written(spark, chat.expand(turns.union(more)), "chat-examples")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat.read_back(examples).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


DECONTAMINATION_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS words
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS words
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM low, size WHERE len(w) >= n)),
occ AS (SELECT doc_id, item_id, pos.n, p FROM pos JOIN win ON pos.n = win.n AND pos.words = win.words),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS place FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT low.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op4_decontaminate", DECONTAMINATION_SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = decontaminate.scan(spark, docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op5_licences")
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that paragraphs of every document state."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.by_document(docs, licences.fit(spark, docs).scan(docs))


@query("op6_shards")
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    placed = sharding.shard(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents by SimHash."""
    found = simhash.near_duplicates(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, budget=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p)
WHERE rank <= 20
"""


@query("op8_top_k", TOPK_SQL)
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector with all others."""
    vectors = topk.whole_numbers(read_table(spark, sf_dir, "embeddings"))
    return topk.search(spark, vectors, vectors.filter("vec_id % 20 = 0"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by supervised subword embeddings."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    scored = quality.score(spark, docs, quality.fit(spark, docs, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(spark, docs.select("doc_id", "text"), langid.fit(spark, docs))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op11_learned_partitions")
def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every 100th vector that its most probable partitions hold."""
    vectors = neighbours.usable(read_table(spark, sf_dir, "embeddings"))
    return neighbours.search(spark, vectors, vectors.filter("vec_id % 100 = 0"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the periodic tails of the contract: of a tenth of the
    documents, by crc32 of doc_id, the words from a on repeat those of [a, a + p)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"),
                       F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), a), tail), F.lit(1), n), " ")
    return docs.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and its text with each run's first period alone."""
    docs = with_planted_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    best = F.reduce("runs", none, lambda a, r: F.when(better(a, r), r).otherwise(a))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    found = runs.detect(docs).select("doc_id", "runs", best.alias("best"), "collapsed")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' ids on the bytes of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align.align(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    found = found.withColumn("groups_sha256", sha).drop("groups").withColumn("row", F.monotonically_increasing_id())
    return align.weigh(spark, written(spark, found, "alignment"))
