"""The pipeline on the smallest test set, and its stages over odd tables."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.compare import compare, duck
from tests.conftest import SF_SMALL
from tests.llm.test_operators import DOCS, _components, _contamination, _corpus, _fingerprint, words


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_chat_examples", "op4_decontaminate", "op8_top_k"])
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E

    assert compare(spark, name, SF_SMALL, E.queries(), E.oracle_sql(), duck(SF_SMALL))


def test_stages(spark):
    """Each stage against brute force over what the stage before kept."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(rows, docs.schema), SF_SMALL)
        assert out.columns == columns
        got = out.collect()
        before, after = {r["doc_id"]: r for r in rows}, [r["doc_id"] for r in got]
        assert all(before[r["doc_id"]] == r for r in got)
        if name == "quality":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter("quality = 0").collect()}
            good = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter("quality = 1").collect()}
            assert len(good & set(after)) >= 0.97 * len(good) and len(bad & set(after)) <= 0.5 * len(bad)
        elif name == "near_duplicates":
            groups = _components([_fingerprint(r["text"]) for r in rows])
            least = {}
            for r in rows:
                root = min(groups[_fingerprint(r["text"])])
                least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
            assert sorted(after) == sorted(least.values())
        elif name == "decontamination":
            want = []
            for r in rows:
                n, hit, _ = _contamination(r["text"], items)
                want += [] if hit and 20 * hit >= n else [r["doc_id"]]
            assert sorted(after) == sorted(want)
        else:
            total = sum(len(words(r["text"])) for r in rows)
            most = max(len(words(r["text"])) for r in rows)
            assert abs(sum(len(words(r["text"])) for r in got) - total) <= most * len({r["source"] for r in rows})
            assert max(after.count(i) for i in set(after)) <= 3
        rows = got
    tokens = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, docs.schema), SF_SMALL)
    assert tokens.count() == len(rows)


@pytest.mark.parametrize("rows", [[], _corpus(n=30)])
def test_stages_over_odd_tables(spark, rows):
    """Nulls, repeated rows, no rows, and extra columns named like the operators' own."""
    docs = spark.createDataFrame(rows, DOCS)
    extra = {c: F.lit(i) for i, c in enumerate(["size", "score", "fp", "root", "_row", "copies", "items", "n_words", "label", "_rest_", "target"])}
    docs = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.count() <= 3 * max(1, len(rows))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == len(rows)


def test_vocabulary_is_found():
    assert public_tokenizers.path("byte_bpe_50k.json")
