"""Bars around an entry: overlapping entries, ends of the history, blocks, entries without a bar."""

from sparkbars.operators.joins import entry_window


def test_entry_window(spark):
    n = {"X": 200, "Y": 7}
    bars = spark.createDataFrame([(s, i, i * 1.5) for s, k in n.items() for i in range(k)], "symbol string, rn long, c double")
    entries = [(i, "X", at) for i, at in enumerate([0, 1, 19, 20, 33, 34, 63, 64, 64, 65, 127, 128, 170, 171, 199])]
    entries += [(50, "Y", 3), (51, "Y", 6), (52, "Z", 4), (53, "X", None)]
    df = spark.createDataFrame(entries, "trade_id long, symbol string, bar_rn long")
    want = sorted((t, r - at, r * 1.5) for t, s, at in entries if at is not None for r in range(max(0, at - 20), min(n.get(s, 0), at + 30)))
    for block in (64, 1, 5, 1000):
        got = entry_window(bars, df, block=block)
        assert got.columns == ["trade_id", "symbol", "bar_rn", "offset", "c"]
        assert sorted((r.trade_id, r.offset, r.c) for r in got.collect()) == want
    assert entry_window(bars, df.limit(0)).count() == 0
