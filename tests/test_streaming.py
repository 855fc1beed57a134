from barwise.streaming.incremental import load_new_bars


def test_files_are_loaded_once(make_bars, spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    make_bars({"A": [1.0, 2.0]}).coalesce(1).write.mode("append").parquet(source)
    assert load_new_bars(spark, source, target, state).count() == 2
    make_bars({"A": [9.0], "B": [3.0]}).coalesce(1).write.mode("append").parquet(source)
    got = sorted((r.ticker, r.close) for r in load_new_bars(spark, source, target, state).collect())
    assert got == [("A", 1.0), ("A", 2.0), ("B", 3.0)]
    assert load_new_bars(spark, source, target, state).count() == 3


def test_a_ticker_may_arrive_in_lots(make_bars, spark, tmp_path):
    import datetime as dt

    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for start, closes in ((dt.date(2020, 1, 1), [1.0, 2.0, 3.0]), (dt.date(2020, 1, 3), [9.0, 4.0]), (dt.date(2019, 12, 31), [0.5])):
        make_bars({"A": closes}, start).coalesce(1).write.mode("append").parquet(source)
        got = load_new_bars(spark, source, target, state)
    assert [r.close for r in got.orderBy("date").collect()] == [0.5, 1.0, 2.0, 3.0, 4.0]
