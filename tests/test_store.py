"""The store of bars: few tasks list it, several a core write it, symbols stay text."""

from sparkbars.sources import files

from .helpers import bars, flat


def _many(spark, n):
    one = bars(spark, flat(3))
    return one.drop("symbol").crossJoin(spark.range(n).selectExpr("lpad(id, 3, '0') AS symbol")).select(*one.columns)


def _tasks(spark, group, job):
    """The most tasks of a stage of the jobs that ``job`` starts."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        job()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    found = sc.statusTracker()
    stages = [s for j in found.getJobIdsForGroup(group) for s in found.getJobInfo(j).stageIds]
    return max(s.numTasks for s in map(found.getStageInfo, stages) if s)


def test_store_is_dealt_into_a_few_tasks_a_core(spark, tmp_path):
    few, path = files.TASKS_PER_CORE * spark.sparkContext.defaultParallelism, str(tmp_path / "store")
    df = _many(spark, few + 33)
    assert _tasks(spark, "store-write", lambda: files.store_write(df, path)) >= few
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    assert _tasks(spark, "store-read", lambda: files.store_read(spark, path, schema=df.schema)) <= few
    assert spark.conf.get(listing) == before


def test_symbols_stay_text(spark, tmp_path):
    path = str(tmp_path / "store")
    df = _many(spark, 12)
    files.store_write(df, path)
    back = files.store_read(spark, path, schema=df.schema)
    assert dict(back.dtypes) == dict(df.dtypes)
    rows = lambda d: sorted(map(tuple, d.select(*df.columns).collect()))
    assert rows(back) == rows(df) and {r[0] for r in rows(back)} == {f"{i:03d}" for i in range(12)}
    assert rows(files.store_read(spark, path, ["007"], df.schema)) == rows(df.filter("symbol = '007'"))
