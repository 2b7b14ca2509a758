"""Event operators on streams: the batch aggregates with a watermark for late filings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_buys(events: DataFrame, on: str, window: str, late: str, least: int) -> DataFrame:
    """A03 on a stream (or a table): (window, asset, n_buyers, value) of windows with `least` buyers or more.

    Buyers are told apart by the set of owners in the window's state, which the window and the watermark bound.
    """
    seen = events.withWatermark(on, late).groupBy(F.window(on, window), "asset")
    counted = seen.agg(F.size(F.collect_set("owner")).alias("n_buyers"), F.sum(F.col("shares") * F.col("price")).alias("value"))
    return counted.where(F.col("n_buyers") >= least).select("window", "asset", "n_buyers", "value")
