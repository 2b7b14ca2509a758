"""Laid-out panels and refreshed caches."""

import os
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import calendar as C
from panelspark.operators import joins as J
from panelspark.operators import windows as W
from panelspark.sources.panels import Cache, drop, lay_out


def exchanges(df):
    """What rows are dealt by in the plan, without names' numbers."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"hashpartitioning[(]([^)]*?)#", plan)


def panel(spark, assets=20, n=30):
    rows = [(a, k, f"2020-{1 + k // 28:02d}-{1 + k % 28:02d}", 100.0 + (a * 37 + k * k * 11) % 23, 10.0 + (a * k) % 7) for a in range(assets) for k in range(n)]
    return spark.createDataFrame(rows, "asset long, i int, date string, close double, volume double").withColumn("date", F.to_date("date"))


def test_windows_of_laid_out_panels_need_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df, filed = panel(spark), panel(spark).where("i % 7 = 3").select("asset", "i", "date", F.col("close").alias("val"))
    laid, events = lay_out(df, name="laid_panel"), lay_out(filed, name="laid_events")
    features = lambda p: p.withColumn("ret", W.simple_return()).withColumns({"beta": W.rolling_ols("ret", "volume", 10, 5)["beta"]})
    for build in (lambda p, e: features(p), lambda p, e: C.forward_price(p, 3), lambda p, e: p.groupBy("asset").agg(F.max("close").alias("top")), lambda p, e: p.withColumn("r", F.row_number().over(Window.partitionBy("asset").orderBy("date")))):
        got, want = build(laid, events), build(df, filed)
        assert exchanges(got) == [] and exchanges(want) != []
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    # Spark's union forgets buckets under a projection, so an as-of join still deals both sides once.
    asof = lambda p, e: J.asof_join(p.select("asset", "date", "close"), e.select("asset", "date", "val"), ["asset"], "date", ["val"])
    assert sorted(map(str, asof(laid, events).collect())) == sorted(map(str, asof(df, filed).collect()))
    drop(spark, "laid_panel", "laid_events")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_refresh_equals_a_rebuild_and_leaves_other_folders_alone(spark, tmp_path):
    every = panel(spark, assets=40)
    cache = Cache(spark, str(tmp_path / "cache"), "asset", "date", parts=8)
    cache.rebuild(every.where("asset not in (5, 17) or i < 4").where("asset <> 23"))
    before, built = files(tmp_path / "cache"), []

    def build(keys):
        built.extend(sorted(r.asset for r in keys.collect()))
        return every.join(keys, "asset", "left_semi")

    assert cache.refresh(every, build, "2020-02-02", 3) == 3 and built == [5, 17, 23]
    assert sorted(map(str, cache.read().select(every.columns).collect())) == sorted(map(str, every.collect()))
    touched = {f"_part={r.p}" for r in cache.placed(every.where("asset in (5, 17, 23)")).select(F.col("_part").alias("p")).distinct().collect()}
    after = files(tmp_path / "cache")
    same = {f: t for f, t in before.items() if f.split("/")[-2] not in touched}
    assert same and all(after[f] == t for f, t in same.items()) and not any(f in after for f in before if f not in same)
    assert cache.refresh(every, build, "2020-02-02", 3) == 0 and files(tmp_path / "cache") == after


def test_a_stale_key_without_new_rows_keeps_its_own(spark, tmp_path):
    every = panel(spark, assets=6, n=10)
    cache = Cache(spark, str(tmp_path / "c"), "asset", "date", parts=2)
    cache.rebuild(every)
    assert cache.refresh(every, lambda keys: every.where("asset = 1").withColumn("close", F.lit(0.0)), "2021-01-01", 3) == 6
    assert cache.read().count() == 60 and cache.read().where("close = 0").count() == 10


def test_written_tables_are_cleared_by_a_call(spark):
    from panelspark.sources import shared

    df = shared.written(panel(spark))
    path = shared.WRITTEN[spark.sparkContext.applicationId][-1].removeprefix("file://")
    assert df.count() == 600 and os.path.isdir(path)
    assert shared.clear(spark) >= 1 and not os.path.exists(path) and shared.clear(spark) == 0
