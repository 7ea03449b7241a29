from datetime import date

from tidemark.operators import panel

LONG = "series string, date date, value double"


def d(n, month=1):
    return date(2024, month, n)


def collect(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


def test_outer_join_and_fill(spark):
    long = spark.createDataFrame(
        [("a", d(1), 1.0), ("b", d(2), 2.0), ("a", d(4), 3.0), ("b", d(9), None)], LONG
    )
    ids = ("a", "b", "never")
    assert collect(panel.outer_panel(long, ids), "date") == [
        (d(1), 1.0, None, None), (d(2), None, 2.0, None), (d(4), 3.0, None, None), (d(9), None, None, None),
    ]
    assert collect(panel.filled_panel(long, ids), "date") == [
        (d(1), 1.0, None, None), (d(2), 1.0, 2.0, None), (d(4), 3.0, 2.0, None), (d(9), 3.0, 2.0, None),
    ]


def test_spine_adds_days_with_nothing(spark):
    rows = [("a", d(1), 1.0), ("a", d(4), None), ("a", d(5), 2.0), ("b", d(31), 7.0), ("b", d(2, 2), 8.0)]
    got = collect(panel.day_spine(spark.createDataFrame(rows, LONG), ["series"]), "series", "date")
    assert got == [
        ("a", d(1), 1.0), ("a", d(2), None), ("a", d(3), None), ("a", d(4), None), ("a", d(5), 2.0),
        ("b", d(31), 7.0), ("b", d(1, 2), None), ("b", d(2, 2), 8.0),
    ]


def test_asof_panel(spark):
    spine = spark.createDataFrame(
        [("x", d(1)), ("x", d(3)), ("y", d(3)), ("x", d(20))], "symbol string, date date"
    )
    long = spark.createDataFrame([("m", d(2), 5.0), ("m", d(10), None), ("n", d(3), 6.0), ("m", d(25), 9.0)], LONG)
    unlimited = panel.asof_panel(spine, long, ["m", "n"]).select("symbol", "date", "m", "n")
    assert collect(unlimited, "date", "symbol") == [
        ("x", d(1), None, None), ("x", d(3), 5.0, 6.0), ("y", d(3), 5.0, 6.0), ("x", d(20), 5.0, 6.0),
    ]
    fresh = panel.asof_panel(spine, long, ["m", "n"], max_age_days=17).select("symbol", "date", "m", "n")
    assert collect(fresh, "date", "symbol")[-1] == ("x", d(20), None, 6.0)


def test_asof_daily_keeps_series_apart(spark):
    spine = spark.createDataFrame(
        [("x", d(1), 1.0), ("x", d(5), 2.0), ("y", d(5), 3.0)], "symbol string, date date, RV double"
    )
    feature = spark.createDataFrame(
        [("x", d(1), 0.1), ("x", d(3), 0.3), ("y", d(6), 0.6)], "symbol string, date date, f double"
    )
    got = panel.asof_daily(spine, feature, "f").select("symbol", "date", "RV", "f")
    assert collect(got, "symbol", "date") == [("x", d(1), 1.0, 0.1), ("x", d(5), 2.0, 0.3), ("y", d(5), 3.0, None)]


def test_term_structure(spark):
    rows = [
        (d(1), "^VIX", 20.0), (d(1), "^VIX9D", 18.0), (d(1), "^VIX3M", 20.0),
        (d(2), "^VIX", 20.0), (d(2), "^VIX9D", 18.0),
        (d(3), "^VIX", 20.0), (d(3), "^VIX9D", 25.0), (d(3), "^VIX3M", 21.0),
    ]
    closes = spark.createDataFrame(rows, "date date, ticker string, close double")
    got = panel.term_structure(closes).select("date", "VIX", "VIX9D", "VX3M", "term_slope", "contango")
    assert collect(got, "date") == [(d(1), 20.0, 18.0, 20.0, 2.0, 0), (d(3), 20.0, 25.0, 21.0, -4.0, 1)]
