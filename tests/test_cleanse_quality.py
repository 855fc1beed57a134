import collections
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from barwise import schemas
from barwise.operators import cleanse, publish, quality
from barwise.sources import files
from conftest import SF

D = dt.date(2020, 1, 1)


def test_null_and_inconsistent_bars_go(make_bars):
    bars = make_bars({"A": [1.0, None, 3.0]})
    bad = bars.withColumn("high", F.when(F.col("close") == 3.0, 0.5).otherwise(F.col("high")))
    assert cleanse.cleanse_bars(bad).count() == 1


def test_low_tolerance(make_bars):
    bars = make_bars({"A": [10.0]}).withColumn("low", F.lit(10.005))
    assert cleanse.filter_bars(bars).count() == 0
    assert cleanse.filter_bars(bars, low_tolerance=0.001).count() == 1


def test_history_gate_counts_repeats_only_when_told(make_bars):
    bars = make_bars({"A": [1.0, 2.0], "B": [1.0]})
    twice = bars.unionByName(bars)
    assert cleanse.min_history(twice, 3, count_repeats=True).count() == 2
    assert cleanse.min_history(twice, 3).count() == 0
    assert cleanse.min_history(bars, 2).select("ticker").distinct().count() == 1


def test_dedup_is_deterministic(make_bars):
    a = make_bars({"A": [1.0]})
    b = a.withColumn("open", F.lit(0.5))
    for df in (a.unionByName(b), b.unionByName(a)):
        assert [r.open for r in cleanse.dedup_bars(df).collect()] == [0.5]


def test_conform_blanks_bad_values(spark):
    text = spark.createDataFrame([(" ab ", "2020-01-01", "x", "2", "1", "1.5", "9", "S"), ("c", "soon", "1", "2", "1", "1", "n", "S")],
                                 "ticker string, date string, open string, high string, low string, close string, volume string, sector string")
    rows = [tuple(r) for r in cleanse.conform_bars(text).collect()]
    assert rows[0] == ("AB", D, None, 2.0, 1.0, 1.5, 9, "S")
    assert rows[1][1] is None and rows[1][6] is None


def test_fundamentals_limits(spark):
    df = spark.createDataFrame([("A", 201.0, -0.1), ("B", -5.0, None), ("C", 200.0, 0.02)], "ticker string, pe_ratio double, dividend_yield double")
    got = {r[0]: tuple(r)[1:] for r in cleanse.cleanse_fundamentals(df).collect()}
    assert got == {"A": (None, 0.0), "B": (-5.0, None), "C": (200.0, 0.02)}
    assert {r.ticker: r.pe_ratio for r in cleanse.cleanse_fundamentals(df, drop_negative_pe=True).collect()}["B"] is None


def test_enrich_keeps_rows_and_prefers_dimension(make_bars, spark):
    bars = make_bars({"A": [1.0, 2.0], "B": [1.0]})
    dim = spark.createDataFrame([("A", "Energy", 1.2)], "ticker string, sector string, beta double")
    rows = {(r.ticker, r.sector, r.beta) for r in cleanse.enrich(bars, dim).collect()}
    assert rows == {("A", "Energy", 1.2), ("B", "Tech", None)}
    assert cleanse.enrich(bars, dim).count() == 3


def test_null_rate_gate(make_bars, spark):
    bars = make_bars({"A": [1.0, None]})
    dim = spark.createDataFrame([("A",)], "ticker string")
    assert cleanse.ingest_report(bars, dim).first()["null_close_pct"] == 0.5
    with pytest.raises(Exception, match="Null close rate"):
        cleanse.ingest_report(bars, dim, max_null_share=0.05).collect()


def test_incremental_load_adds_new_tickers_only(make_bars):
    old, new = make_bars({"A": [1.0]}), make_bars({"A": [9.0, 9.0], "B": [2.0]})
    got = sorted((r.ticker, r.close) for r in cleanse.incremental_load(old, new).collect())
    assert got == [("A", 1.0), ("B", 2.0)]


def test_round_trips(make_bars, spark, tmp_path):
    bars = make_bars({"A": [1.0, 2.5]})
    want = sorted(map(tuple, bars.collect()))
    p = files.write_parquet(bars, str(tmp_path / "p"), ["sector"])
    assert sorted(map(tuple, files.read_parquet(spark, p, schemas.BARS).collect())) == want
    c = files.write_csv(bars, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, c, schemas.BARS).collect())) == want


def test_views(make_bars, spark):
    files.register_views(quotes=make_bars({"A": [1.0, 2.0]}))
    assert spark.sql("SELECT max(close) AS m FROM quotes").first().m == 2.0


def session(master, folder):
    from types import SimpleNamespace as NS

    return NS(conf=NS(get=lambda key, default: folder), sparkContext=NS(master=master))


def test_shared_folder_follows_the_session():
    assert files.shared_folder(session("yarn", "hdfs:///shared")).startswith("hdfs:///shared/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.shared_folder(session("yarn", None))


def test_buckets_save_the_shuffle(spark, make_bars, tmp_path):
    from pyspark.sql import Window

    stored = files.write_bucketed(make_bars({"A": [1.0, 2.0, 4.0], "B": [3.0, 6.0]}), "bucketed_bars", buckets=4, path=str(tmp_path / "b"))
    moves = stored.withColumn("m", F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")))
    joined = moves.join(spark.table("bucketed_bars").select("ticker", "date", F.col("close").alias("c")), ["ticker", "date"])
    plan = moves._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and joined.count() == 5 and sorted(r.m for r in moves.filter("m IS NOT NULL").collect()) == [2.0, 2.0, 2.0]
    spark.sql("DROP TABLE bucketed_bars")


def test_a_rerun_replaces_its_partition(spark, make_bars, tmp_path):
    rows = make_bars({"A": [1.0, 2.0, 3.0]}).select("ticker", "close", F.dayofmonth("date").alias("d"))
    path = files.write_parquet(rows, str(tmp_path / "p"), ["d"])
    files.replace_partitions(rows.filter("d = 2").withColumn("close", F.lit(9.0)), path, ["d"])
    assert sorted((r.d, r.close) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 9.0), (3, 3.0)]


def test_views_of_a_run_are_their_own(spark, make_bars):
    bars = make_bars({"A": [1.0, 2.0]})
    with files.shared_views(bars=bars) as a, files.shared_views(bars=bars.limit(1)) as b:
        assert a["bars"] != b["bars"] and spark.catalog.isCached(a["bars"])
        assert spark.sql(f"SELECT count(*) FROM {a['bars']}").first()[0] == 2 and spark.sql(f"SELECT count(*) FROM {b['bars']}").first()[0] == 1
    assert not spark.catalog.tableExists(a["bars"])


def test_wide_rows(spark, make_bars):
    bars = make_bars({"A": [1.0, None, 3.0], "B": [5.0]})
    want = sorted((r.ticker, r.date, r.open, r.close) for r in bars.filter("close IS NOT NULL").collect())
    told = lambda df: sorted((r.ticker, r.date, r.open, r.close) for r in df.collect())
    assert told(cleanse.wide_to_long(cleanse.wide_bars(bars))) == want
    header = bars.groupBy("date").agg(*[F.max(F.when(F.col("ticker") == t, F.col(f))).alias(f"{f}|{t}") for t in "AB" for f in ("open", "close")])
    assert told(cleanse.wide_to_long(header)) == want
    assert {r.date: dict(r.returns) for r in cleanse.returns_wide(bars.withColumn("daily_return", F.col("close"))).collect()}[D] == {"A": 1.0, "B": 5.0}


def checks(df, **kw):
    return {r.check_name: r for r in quality.quality_checks(df, "bronze", as_of="2020-01-03 00:00:00", **kw).collect()}


def test_clean_report(make_bars):
    got = checks(make_bars({"A": [10.0, 10.1, 10.2]}))
    assert {r.status for r in got.values()} == {"PASS"} and len(got) == 8


def test_faults_are_found(make_bars):
    bars = make_bars({"A": [10.0, 20.0, None]})
    df = bars.unionByName(bars.limit(0)).unionByName(make_bars({"A": [10.0]}))
    df = df.withColumn("high", F.when(F.col("close") == 20.0, 1.0).otherwise(F.col("high")))
    got = checks(df)
    assert got["duplicates"].affected_rows == 1 and got["duplicates"].status == "FAIL"
    assert got["price_moves"].affected_rows == 1 and got["price_moves"].status == "WARN"
    assert got["ohlc_consistency"].affected_rows == 1
    assert "close" in got["null_rates"].affected_cols
    score = quality.quality_score(quality.quality_checks(df, "bronze", as_of="2030-01-01")).first()
    assert (score.failed, score.warned, score.overall_score) == (3, 2, 64.0)


def test_strict_raises(make_bars):
    with pytest.raises(quality.QualityError, match="required_columns"):
        quality.assert_quality(make_bars({"A": [1.0]}).drop("close"), "bronze")
    cfg = quality.QualityConfig(strict=False)
    assert quality.assert_quality(make_bars({"A": [1.0]}).drop("close"), "bronze", cfg)


def test_a_hot_key_collapses_before_grouping(spark, make_bars):
    """A key with most of the rows: repeats are cut per map task."""
    hot = make_bars({"A": [1.0]}).crossJoin(spark.range(20000)).drop("id").repartition(8)
    df = hot.unionByName(make_bars({"B": [1.0, 2.0]}))
    assert cleanse.dedup_bars(df).count() == 3
    assert "WindowGroupLimit" in cleanse.dedup_bars(df)._jdf.queryExecution().executedPlan().toString()
    assert checks(df)["duplicates"].affected_rows == 19999


def test_layers_are_gated(spark, make_bars, tmp_path):
    """Half of the closes missing: the strict run stops at bronze, the lenient one scores every layer."""
    bars = make_bars({t: [None if i % 2 else 10.0 + i % 7 for i in range(300)] for t in "AB"})
    text = bars.select(*[F.col(c).cast("string").alias(c) for c in bars.columns])
    strict = publish.Run(spark, str(tmp_path / "strict"), as_of="2020-10-27")
    with pytest.raises(quality.QualityError, match="bronze.*null_rates"):
        strict.go(text, publish.bar_steps(50))
    assert strict.published == {} and sorted(os.listdir(tmp_path / "strict")) == ["bronze", "raw"]  # written, not published
    lenient = publish.Run(spark, str(tmp_path / "lenient"), quality.QualityConfig(strict=False), "2020-10-27").go(text, publish.bar_steps(50))
    audit = {r.layer: r for r in lenient.audit().collect()}
    assert audit["bronze"].quality_score == 90.0 and audit["features"].quality_score == 100.0
    assert audit["silver"].records_in == audit["bronze"].records_out == 600 and audit["silver"].records_out == 300
    assert audit["total"].records_in == 600 + 600 + 300 + 300
    assert lenient.layer("gold").count() == 300


def test_a_fault_planted_in_a_query_raises(spark, monkeypatch):
    """The gated query stops at the layer in which the fault shows, and later layers are never built."""
    from barwise.plans import catalog

    built = []
    clean = publish.bar_steps

    def faulty(min_days=252):
        steps = clean(min_days)
        silver = steps[1].build
        steps[1].build = lambda b: silver(b).withColumn("close", F.when(F.col("date") != "1995-06-01", F.col("close") * -1).otherwise(F.col("close")))
        gold = steps[3].build
        steps[3].build = lambda f: built.append(1) or gold(f)
        return steps

    monkeypatch.setattr(publish, "bar_steps", faulty)
    with pytest.raises(quality.QualityError, match="silver.*numeric_ranges"):
        catalog.BUILDERS["gated_sector_agg"](spark, SF)
    assert built == []


def test_layers_are_moved_and_stored_once(spark):
    """Every layer lies in buckets by ticker, so windows and key checks over it shuffle no rows; features are columns of gold's files."""
    from pyspark.sql import Window
    from barwise.plans import catalog
    from barwise.plans.frames import Frames

    t = Frames(spark, SF)
    t.tasks = 3  # more than the one that so few rows ask for
    run = catalog._gated(t, t.text_bars, strict=False)
    assert sorted(os.listdir(run.folder)) == ["bronze", "gold", "manifest", "raw", "sector_agg", "silver"]
    for name in ("bronze", "silver", "features", "gold"):
        last = run.layer(name).withColumn("last", F.lag("close").over(Window.partitionBy("ticker").orderBy("date")))
        assert "Exchange" not in last._jdf.queryExecution().executedPlan().toString()
    keyed = quality.keyed_checks(run.layer("gold").select("ticker", "date", "daily_return"), quality.QualityConfig())
    assert keyed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of one row a task
    for name in ("bronze", "features"):
        got, want = run.layer(name), t.layers[name]
        assert got.columns == want.columns
        known = [c for c in want.columns if c != "_bronze_loaded_at"]
        assert collections.Counter(map(tuple, got.select(*known).collect())) == collections.Counter(map(tuple, want.select(*known).collect()))


class Stopped(Exception):
    pass


@pytest.mark.parametrize("name", ["layer_audit", "gated_gold", "gated_sector_agg"])
def test_gated_queries_follow_the_rows(spark, monkeypatch, name):
    """The run of a query deals its rows to as many tasks as they ask for."""
    from barwise.plans import catalog
    from barwise.plans.frames import Frames

    def go(run, raw, steps):
        assert [s.name for s in steps if s.with_next] == ["features"]
        raise Stopped(run.tasks)

    monkeypatch.setattr(publish.Run, "go", go)
    monkeypatch.setattr(Frames, "tasks", 7)
    with pytest.raises(Stopped, match="7"):
        catalog.BUILDERS[name](spark, SF)


@pytest.mark.parametrize("tasks", [None, 3])
def test_features_stay_when_gold_fails(spark, make_bars, tmp_path, tasks):
    """Gold shares its files with the features; if it fails its checks, they are published and it is not."""
    bars = make_bars({t: [10.0 + i % 7 for i in range(300)] for t in "ABC"})
    text = bars.select(*[F.col(c).cast("string").alias(c) for c in bars.columns])
    steps = publish.bar_steps(50)
    gold = steps[3].build
    steps[3].build = lambda f: gold(f).withColumn("close", -F.col("close"))
    run = publish.Run(spark, str(tmp_path / "run"), as_of="2020-10-27", tasks=tasks)
    with pytest.raises(quality.QualityError, match="gold.*numeric_ranges"):
        run.go(text, steps)
    assert list(run.published) == ["bronze", "silver", "features"] and run.layer("features").count() == 900
    assert "signal_score" not in run.layer("features").columns
    assert {r.layer: (r.step, r.records_in, r.records_out) for r in run.audit().collect()}["features"] == (3, 900, 900)


def test_moves_of_a_dominating_ticker(spark):
    """A ticker with nearly all rows and many closes a day is summed before it is shuffled; the count is exact."""
    rng = random.Random(8)
    rows = [("HOT", dt.date(2020, 1, 1 + i % 9), rng.choice([0.0, None, -3.0, 1e-9, *[rng.uniform(0.5, 50) for _ in range(6)]])) for i in range(4000)]
    rows += [(t, dt.date(2020, 1, d), c) for t in "AB" for d, c in enumerate([5.0, 8.0, 2.0, None, 2.0, 7.0], 1)]
    for limit in (0.5, 0.01, 3.0):
        want = 0
        for t in {r[0] for r in rows}:
            chain = sorted(((d, c is not None, c or 0.0) for k, d, c in rows if k == t))
            chain = [c if known else None for _, known, c in dict.fromkeys(chain)]
            want += sum(a is not None and b is not None and a != 0 and abs((b - a) / a) > limit for a, b in zip(chain, chain[1:]))
        df = spark.createDataFrame(rows, "ticker string, date date, close double").repartition(8)
        moves = quality.close_moves(df, limit)
        assert moves.agg(F.sum("moves")).first()[0] == want and moves.agg(F.sum("n")).first()[0] == len(rows)
    hot = spark.range(200_000).select(F.lit("HOT").alias("ticker"), F.lit("2020-01-01").cast("date").alias("date"), (1 + F.rand(1)).alias("close"))
    plan = quality.close_moves(hot, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") > plan.index("Window") and "partial_min" in plan
