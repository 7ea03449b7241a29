"""The shape of the physical plans: what is scanned, shuffled and run in Python."""

import re

import pytest

from tidemark.operators import daily, news, vpin
from tidemark.plans import testdata
from tidemark.plans.queries import QUERIES, TICK


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


IN_JVM = sorted(set(QUERIES) - {"confidence_set", "stored_bars_range", "stream_bars", "stream_book_imbalance", "stream_vpin"})
# These end in one row per dataset or column, so their last step is one small task.
ONE_ROW = {"profile_table", "quality_report", "schema_bad_cells"}


@pytest.mark.parametrize("name", IN_JVM)
def test_no_python_no_single_partition_no_product(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "InPandas" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ONE_ROW:
        assert "SinglePartition" not in text


def test_daily_features_read_and_shuffle_the_bars_once(spark, sf_dir):
    trades = testdata.daily_ticks(spark, sf_dir)
    text = plan(daily.daily_features(trades, ties=testdata.DAILY_TICK_TIES))
    assert text.count("FileScan") == 1
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    assert sorted(re.sub(r"#\d+", "", k) for k in keys) == ["symbol", "symbol, date"]
    assert "BroadcastExchange" not in text


def test_unused_measures_are_pruned(spark, sf_dir):
    text = plan(daily.realized_daily(testdata.daily_ticks(spark, sf_dir), ties=testdata.DAILY_TICK_TIES))
    assert "var_pop" not in text and "covar_pop" not in text
    scan = re.search(r"ReadSchema: (struct<[^>]*>)", plan(QUERIES["vpin_daily"](spark, sf_dir)))
    assert "user_id" not in scan.group(1)


def test_vpin_shuffles_rows_once_without_joins(spark, sf_dir):
    text = plan(vpin.vpin_daily(testdata.ticks(spark, sf_dir).drop("is_buyer_maker"), **TICK))
    assert "Join" not in text
    assert text.count("FileScan") == 2


def test_day_bounds_reach_the_scan(spark, sf_dir, tmp_path, capsys):
    testdata.gkg(spark, sf_dir).write.parquet(f"{tmp_path}/gkg")
    stored = spark.read.parquet(f"{tmp_path}/gkg")
    news.event_news_daily(stored, "2024-01-05", "2024-01-25").explain("formatted")
    text = capsys.readouterr().out
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text).group(1)
    assert "GreaterThanOrEqual(DATE" in pushed and "LessThan(DATE" in pushed
