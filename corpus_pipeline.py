"""Corpus pipeline: quality, near-duplicates, decontamination, mix, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder and hands the table read back to the next
stage. Stages carry unknown columns of ``docs`` along unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbars.llm import decontaminate, mixing, quality, simhash
from sparkbars.llm.common import packed, read_table, unpacked, word_count, written
from sparkbars.llm.queries import query, token_planes


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, scored by their
    whole text. It learns from the labelled rows of ``docs``."""
    keys = ("doc_id", "text")
    model = quality.fit(spark, docs.select(*keys), read_table(spark, sf_dir, "labels"))
    scored = quality.score(spark, packed(docs, *keys), model)
    return unpacked(scored.filter(F.col("score") >= quality.THRESHOLD), docs.columns, *keys)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3-word shingles, 3 bits): the smallest id's."""
    keys = ("doc_id", "text")
    return unpacked(simhash.one_of_each(spark, packed(docs, *keys), shingle=3, budget=3), docs.columns, *keys)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    keys = ("doc_id", "text")
    kept = decontaminate.clean(spark, packed(docs, *keys), read_table(spark, sf_dir, "benchmark"))
    return unpacked(kept, docs.columns, *keys)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document comes once for every epoch that
    reaches it, whole also where its source is cut."""
    keys = ("doc_id", "text", "source")
    sized = packed(docs, *keys).withColumn("size", word_count(F.col("text")))
    return unpacked(mixing.repeated(mixing.mix(sized, "size"), [*keys, "_rest"]), docs.columns, *keys)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards of the mix, as read back: one row per document of the mix."""
    return token_planes(spark, docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mix", mixing_stage),
    ("tokens", token_stage),
]

#: Hashes with a seed, learned weights and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


query("pipeline")(run)
