"""Filters and repairs of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.calendar import calendar


def ffill_limit(dense: DataFrame, limit: int | None = 5, col: str = "close") -> DataFrame:
    """The column filled with the last value at most `limit` calendar rows before (None: any)."""
    w = Window.partitionBy("asset").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("v"), F.col("i").alias("at"))), ignorenulls=True).over(w)
    near = F.lit(True) if limit is None else F.col("i") - last["at"] <= limit
    return dense.withColumn(col, F.when(near, last["v"]))


def bfill(dense: DataFrame, col: str = "close") -> DataFrame:
    """The column filled with the next value. Looks ahead: for parity only."""
    w = Window.partitionBy("asset").orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    return dense.withColumn(col, F.first(col, ignorenulls=True).over(w))


def min_obs_filter(panel: DataFrame, n: int, col: str = "close") -> DataFrame:
    """Assets with at least n values."""
    enough = panel.groupBy("asset").agg(F.count(col).alias("n")).where(F.col("n") >= n)
    return panel.join(enough, "asset", "left_semi")


def missing_frac_filter(panel: DataFrame, most: float, full_share: float = 0.5) -> DataFrame:
    """Assets missing on at most `most` of the calendar's dates, then dates on which at least full_share of
    the assets without any gap among those have a value (one at least); without such assets all dates stay."""
    total = calendar(panel).agg(F.count(F.lit(1)).alias("total"))
    seen = panel.where("close is not null").groupBy("asset").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    kept = seen.where(1 - F.col("n") / F.col("total") <= most)
    full = kept.where("n = total").select("asset")
    need = full.agg(F.greatest(F.lit(1), F.floor(full_share * F.count(F.lit(1)))).alias("need"), F.count(F.lit(1)).alias("n_full"))
    own = panel.join(kept.select("asset"), "asset", "left_semi")
    days = own.where("close is not null").join(full.withColumn("full", F.lit(1)), "asset", "left").groupBy("date").agg(F.count("full").alias("have"))
    good = days.join(F.broadcast(need)).where("n_full = 0 or have >= need").select("date")
    return own.join(good, "date", "left_semi")


def pit_universe(panel: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """Priced rows whose (date, asset) is a member, on dates with at least `least` of them."""
    rows = panel.where("close is not null").join(members, ["date", "asset"], "left_semi")
    return min_names(rows, least)


def min_names(rows: DataFrame, least: int, *by: str) -> DataFrame:
    """Rows of dates that have at least `least` rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy("date", *by))
    return rows.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def segment(df: DataFrame, split: str, date: str = "date") -> DataFrame:
    """Segment 'dev' before the split date, 'oos' from it on."""
    return df.withColumn("segment", F.when(F.col(date) < F.lit(split).cast("date"), "dev").otherwise("oos"))


def purchase_filter(df: DataFrame) -> DataFrame:
    """Code P, with flag A or none."""
    return df.where((F.upper("code") == "P") & (F.col("flag").isNull() | (F.upper("flag") == "A")))


def duration_filter(df: DataFrame, low: int, high: int, start: str = "start", end: str = "end") -> DataFrame:
    """P10: rows whose period has low to high days."""
    return df.where(F.datediff(end, start).between(low, high))


def duration_bands(df: DataFrame, forms: list[str], bands: dict[str, tuple[int, int]]) -> DataFrame:
    """P10: filed rows (start, end, form, fp) of these forms whose period is as long as its fiscal period says: `bands` has the
    days for the first letter of fp, so quarters keep no sums of the year to date. Rows without a start or end go."""
    days = F.datediff("end", "start")
    fits = F.lit(False)
    for first, (low, high) in bands.items():
        fits = fits | (F.substring("fp", 1, 1) == first) & days.between(low, high)
    return df.where(F.col("form").isin(forms) & fits)


def finite_fill(dense: DataFrame, col: str) -> DataFrame:
    """Infinities to null, then filled forward, then 0."""
    bare = dense.withColumn(col, F.when(F.abs(F.col(col)) != float("inf"), F.col(col)))
    return ffill_limit(bare, None, col).withColumn(col, F.coalesce(F.col(col), F.lit(0.0)))


def zero_features(df: DataFrame, families: dict[str, list[str]], off: list[str]) -> DataFrame:
    """Columns of the families in `off` set to 0."""
    return df.withColumns({c: F.lit(0.0) for f in off for c in families[f] if c in df.columns})


def zscore_global(df: DataFrame, *names: str, eps: float = 1e-8) -> DataFrame:
    """(x - mean) / (std + eps) over the whole table. Looks ahead if used on a sample with later rows."""
    facts = df.agg(*[f(n).alias(f"_{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.join(F.broadcast(facts)).withColumns({n: (F.col(n) - F.col(f"_m_{n}")) / (F.col(f"_s_{n}") + eps) for n in names})
    return out.select(*df.columns)


def date_range(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Rows from start to end, both included."""
    return df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def known(c: Column) -> Column:
    """A-1: NaN as null."""
    return F.when(~F.isnan(c), c)
