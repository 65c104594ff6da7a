"""A task of a stage with many sorts takes a bounded number of bars, however many there are."""

from pyspark.sql import functions as F

from sparkbars.operators import analysis
from sparkbars.params import Params
from sparkbars.plans import layout as lay
from tests.helpers import bars

P = Params(block_rows=64, halo_back=40, halo_ahead=8)


def _bars(spark, n=600):
    return bars(spark, [(100.0 + i % 7, 101.0 + i % 7, 99.0 + i % 5, 100.0 + i % 5, 10 + i % 3) for i in range(n)])


def test_tasks_grow_with_the_bars(spark):
    pan = lay.layout(_bars(spark), P)
    least = spark.sparkContext.defaultParallelism
    assert pan.total() == 600
    assert pan.spread(10).df.rdd.getNumPartitions() == max(least, 60)
    assert pan.spread().df.rdd.getNumPartitions() == least
    per_blk = pan.spread(10).df.withColumn("task", F.spark_partition_id()).groupBy("blk").agg(F.countDistinct("task").alias("k"))
    assert per_blk.filter("k > 1").count() == 0


def test_same_metrics(spark):
    pan = lay.layout(_bars(spark), P)
    one, many = (analysis.advanced_metrics(analysis.bar_inputs(x, P).core(), P).collect() for x in (pan, pan.spread(10)))
    assert [r.symbol for r in one] == ["X"]
    for a, b in zip(one[0], many[0]):
        assert a == b or abs(a - b) <= 1e-9 * abs(a)


def test_metrics_queries_are_dealt_by_counted_rows(spark, tmp_path, monkeypatch):
    from sparkbars.plans import q_analysis

    dealt = []
    spread = lay.Panel.spread
    monkeypatch.setattr(lay.Panel, "spread", lambda self, *a: dealt.append(self.total()) or spread(self, *a))
    q_analysis.inputs_df(spark, "/root/testdata/sf0.001")
    assert dealt and dealt[0] > 0
