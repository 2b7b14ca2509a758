"""Joins of panels, events and dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.blocks import BLOCK, DEALT, dealt
from panelspark.operators.calendar import calendar


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, cols: list[str], direction: str = "backward", strict: bool = False, tolerance_days: int | None = None) -> DataFrame:
    """Left with `cols` of the nearest right row at or before `on` (or after it; strictly, if asked), null if none
    lies within the tolerance. right has one row for each (by, on).

    One shuffle by key and one sort: both sides are stacked, and the last known right row is carried along.
    """
    back = direction == "backward"
    names = [c for c in left.columns if c not in (*by, on)]
    tagged_left = left.select(*by, F.col(on).alias("_on"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in names], F.col(on)).alias("_l"))
    tagged_right = right.select(*by, F.col(on).alias("_on"), F.lit(2 if strict else 0).alias("_side"), F.struct(*[F.col(c) for c in cols], F.col(on).alias("_at")).alias("_r"))
    both = tagged_left.unionByName(tagged_right, allowMissingColumns=True)
    order = [F.col("_on") if back else F.col("_on").desc(), F.col("_side")]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    near = F.lit(True) if tolerance_days is None else F.abs(F.datediff("_on", "_r._at")) <= tolerance_days
    return met.select(*by, "_l.*", *[F.when(near, F.col(f"_r.{c}")).alias(c) for c in cols])


def landing_join(dense: DataFrame, right: DataFrame, on: str, cols: list[str]) -> DataFrame:
    """Dense panel (asset, date, i) with `cols` of the right row dated exactly on the calendar date, then filled
    forward. Rows dated off the calendar are lost: a quirk kept for parity; asof_join has none."""
    met = dense.join(right.select("asset", F.col(on).alias("date"), *cols), ["asset", "date"], "left")
    w = Window.partitionBy("asset").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def event_window_join(rebalances: DataFrame, dates: DataFrame, events: DataFrame, on: str, k: int) -> DataFrame:
    """(date, event columns) for events strictly between the calendar date k rows before a rebalance and the rebalance.

    An event is placed at the first calendar row on or after its day, and expanded to the k rows behind it, so
    rebalances meet it by equality on the row number.
    """
    cal = calendar(dates)
    step = Window.orderBy("date")
    gaps = cal.withColumn("before", F.lag("date").over(step))
    days = gaps.select("i", F.explode(F.sequence(F.coalesce(F.date_add("before", 1), F.date_sub("date", 3660)), F.col("date"))).alias(on), F.col("date").alias("_landed"))
    placed = events.join(days, on)
    # An event on a calendar date is before the next row; one between dates is before the row that it lands on.
    first = F.when(F.col(on) == F.col("_landed"), F.col("i") + 1).otherwise(F.col("i"))
    last = F.col("i") + k - 1
    return placed.where(first <= last).withColumn("i", F.explode(F.sequence(first, last))).join(rebalances.select("date", "i"), "i").drop("i", "_landed")


def routine_flag(df: DataFrame, owner: str = "owner", filed: str = "filed") -> DataFrame:
    """Df with is_routine: the owner also has rows in the same month of each of the two years before."""
    months = df.select(F.col(owner).alias("_o"), F.year(filed).alias("_y"), F.month(filed).alias("_m")).distinct()
    seen = months.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("_o", "_m").orderBy("_y").rangeBetween(-2, -1)))
    return df.join(seen, (df[owner] == seen["_o"]) & (F.year(filed) == seen["_y"]) & (F.month(filed) == seen["_m"]), "left").withColumn("is_routine", F.col("_c") == 2).drop("_o", "_y", "_m", "_c")


def filing_merge(transactions: DataFrame, submissions: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Transactions with their submission (kept only with one) and owner: the key stands for a missing owner,
    false for a missing flag."""
    met = transactions.join(submissions, key).join(owners, key, "left")
    return met.withColumns({"owner": F.coalesce(F.col("owner"), F.col(key)), "is_officer": F.coalesce("is_officer", F.lit(False))})


def inner_align(frames: list[DataFrame], on: str = "date") -> DataFrame:
    """Series joined on the dates that all have."""
    return reduce(lambda a, b: a.join(b, on), frames)


def pairs_within(members: DataFrame, group: str = "sector", size: int = BLOCK) -> DataFrame:
    """(group, a, b), a < b, within each group. Pairs are quadratic in a group by definition; blocks of about `size` members
    meet in cells, which are dealt to tasks, so no task has a whole group, and shuffled rows are members times blocks."""
    cell = [group, "_low", "_high"]
    each = dealt(members.select(group, "asset"), [group], "asset", size)
    side = lambda x, own, other: each.select(group, F.col("asset").alias(x), F.col("_own").alias(own), F.col("_other").alias(other)).repartition(DEALT, *cell)
    return side("a", "_low", "_high").join(side("b", "_high", "_low").hint("merge"), cell).where("a < b").select(group, "a", "b")


def with_dimension(df: DataFrame, seed: DataFrame, cached: DataFrame, key: str, value: str, default: str = "Unknown") -> DataFrame:
    """Df with the value of its key: of the seed first, then of the cache, then the default. Spark broadcasts
    either side if its size allows."""
    out = df.join(seed.select(key, F.col(value).alias("_s")), key, "left").join(cached.select(key, F.col(value).alias("_c")), key, "left")
    return out.withColumn(value, F.coalesce("_s", "_c", F.lit(default))).drop("_s", "_c")
