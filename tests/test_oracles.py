"""Registered queries against their DuckDB oracle on the smallest test set."""

import pytest

from tests.compare import compare, duck
from tests.conftest import SF_SMALL

FAST = ["core_features", "regime", "regime_stats", "dominant_regime", "triple_barrier_long", "triple_barrier_short",
        "meta_labels", "trade_kpis", "regime_kpis", "nearest_bar_join", "best_policy", "trade_review",
        "wide_features", "macd", "advanced_metrics", "trading_signals", "insights", "log_trade_entries",
        "log_scanner_rows", "resample_bars", "src_csv_bars", "src_candle_json", "store_catalog", "clamp_duration",
        "review_windows", "score_metrics", "purged_split", "stream_bars", "trade_marks", "review_by_date",
        "review_summary_by_date", "trade_path_join", "scenario_trail", "delta_r"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E

    assert compare(spark, name, SF_SMALL, E.queries(), E.oracle_sql(), con)


def test_every_query_is_registered_with_docs():
    import __spark_entry__ as E

    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 75
    for name, fn in q.items():
        assert fn.__doc__, name


def test_entry_runs(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
