"""Calendars: row numbers of dates, dense panels, rebalance dates, and rows that lie a number of dates ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(panel: DataFrame) -> DataFrame:
    """(date, i): distinct dates with their number from 0. One row a date, so one ordered partition is enough."""
    return panel.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))


def densify(panel: DataFrame) -> DataFrame:
    """The panel with a row for every calendar date from an asset's first to its last, and the date's number i.

    Lags and frames then count calendar rows. The grid is bounded by each asset's listing span; the calendar,
    one row a date, is what joins to it.
    """
    cal = calendar(panel)
    span = panel.join(cal, "date").groupBy("asset").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    grid = span.select("asset", F.explode(F.sequence("lo", "hi")).alias("i")).join(cal, "i")
    return grid.join(panel, ["asset", "date"], "left")


def rebalance_calendar(dates: DataFrame, warmup: int, freq: int) -> DataFrame:
    """Every freq-th date from number `warmup` on, as (date, i)."""
    return calendar(dates).where((F.col("i") >= warmup) & ((F.col("i") - warmup) % freq == 0))


def next_trading_day(events: DataFrame, dates: DataFrame, on: str) -> DataFrame:
    """Events with next_date, the first calendar date strictly after `on`; null past the calendar's end.

    Days up to the next date are expanded from the calendar (one row a day), so the join is by equality.
    """
    step = Window.orderBy("date")
    gaps = dates.select("date").distinct().select(F.col("date").alias("next_date"), F.lag("date").over(step).alias("before"))
    first = F.coalesce("before", F.date_sub("next_date", 3660))
    days = gaps.select("next_date", F.explode(F.sequence(first, F.date_sub("next_date", 1))).alias(on))
    return events.join(days, on, "left")


def forward_price(dense: DataFrame, freq: int, close: str = "close") -> DataFrame:
    """Dense panel with fwd_close, the price freq rows ahead, or at the calendar's last row if that is nearer; null if the
    asset has no row there. An asset's rows are without gaps, so this is one window by asset."""
    last = dense.agg(F.max("i").alias("_end"))  # one row
    w = Window.partitionBy("asset").orderBy("i")
    at_end = F.max(F.when(F.col("i") == F.col("_end"), F.col(close))).over(Window.partitionBy("asset"))
    ahead = F.when(F.col("i") + freq <= F.col("_end"), F.lead(close, freq).over(w)).otherwise(at_end)
    return dense.join(F.broadcast(last)).withColumn("fwd_close", ahead).drop("_end")
