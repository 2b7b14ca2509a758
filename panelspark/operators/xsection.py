"""Cross-sections: operators within one date, partitioned by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import average_rank, correlation, row_mean

DATE = ("date",)


def over(*by: str):
    return Window.partitionBy(*(by or DATE))


def winsorize(c: str, low: float = 0.02, high: float = 0.98, least: int = 5, by: tuple[str, ...] = DATE) -> Column:
    """Clipped to interpolated quantiles of the date; unchanged with fewer than `least` values."""
    q = F.percentile(c, F.array(F.lit(low), F.lit(high))).over(over(*by))
    few = F.count(c).over(over(*by)) < least
    return F.when(few | F.col(c).isNull(), F.col(c)).otherwise(F.greatest(F.least(F.col(c), q[1]), q[0]))


def zscore(c: str, least: int = 5, by: tuple[str, ...] = DATE) -> Column:
    """Z-score of the date; 0 for all rows if the deviation is under 1e-12 or fewer than `least` values are known."""
    w = over(*by)
    s = F.stddev_samp(c).over(w)
    flat = s.isNull() | (s < 1e-12) | (F.count(c).over(w) < least)
    return F.when(flat, 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / s)


def demean(c: str, *by: str) -> Column:
    """Less the mean of the date (and of further columns)."""
    return F.col(c) - F.avg(c).over(over("date", *by))


def neutral(df: DataFrame, c: str, out: str, group: str = "sector", least: int = 5) -> DataFrame:
    """Demeaned within the group, then z-scored; rows without a group have no mean and so no value."""
    mean = F.when(F.col(group).isNotNull(), demean(c, group))
    return df.withColumn("_d", mean).withColumn(out, zscore("_d", least)).drop("_d")


def pct_rank(c: str, by: tuple[str, ...] = DATE) -> Column:
    """X11: average rank over the number of values; null for null."""
    return average_rank(c, *by) / F.count(c).over(over(*by))


def composite(df: DataFrame, weights: dict[str, float], out: str, least: int = 3, eps: float = 1e-8) -> DataFrame:
    """Weighted sum of z-scores, a column counting only on dates where it has `least` values and a
    deviation of eps or more; a missing value adds 0; divided by the sum of the counting weights (absolute)."""
    w = over()
    total, used = F.lit(0.0), F.lit(0.0)
    for c, weight in weights.items():
        s = F.stddev_samp(c).over(w)
        counts = (F.count(c).over(w) >= least) & (s >= eps)
        total = total + F.coalesce(F.when(counts, weight * (F.col(c) - F.avg(c).over(w)) / s), F.lit(0.0))
        used = used + F.when(counts, abs(weight)).otherwise(0.0)
    return df.withColumn(out, F.when(used > 0, total / used))


def factor_scores(df: DataFrame, factors: list[str], mixed: list[str], group: str = "sector") -> DataFrame:
    """Each factor winsorised and neutralised by group, and the mean of those named in `mixed` as composite."""
    for f in factors:
        df = neutral(df.withColumn("_w", winsorize(f)), "_w", f"{f}_z", group).drop("_w")
    return df.withColumn("composite", row_mean(*[f"{f}_z" for f in mixed]))


def mean_of_zscores(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Df with the z-score of each column, winsorised, as <column>_z, and the mean of those known as `out`."""
    for c in columns:
        df = df.withColumn("_w", winsorize(c)).withColumn(f"{c}_z", F.when(F.col("_w").isNotNull(), zscore("_w"))).drop("_w")
    return df.withColumn(out, row_mean(*[f"{c}_z" for c in columns]))


def softmax_topn(df: DataFrame, score: str, n: int, floor: float) -> DataFrame:
    """Weight of the names ranked n or better (ties kept): softmax, at least `floor`, made to sum to 1."""
    top = df.where(F.col(score).isNotNull()).withColumn("_r", F.rank().over(over().orderBy(F.col(score).desc()))).where(F.col("_r") <= n)
    e = F.exp(F.col(score) - F.max(score).over(over()))
    top = top.withColumn("_e", e).withColumn("_e", F.greatest(F.col("_e") / F.sum("_e").over(over()), F.lit(floor)))
    return top.withColumn("weight", F.col("_e") / F.sum("_e").over(over())).drop("_r", "_e")


def rank_ic(df: DataFrame, score: str, fwd: str, least: int = 10, by: tuple[str, ...] = DATE) -> DataFrame:
    """Spearman correlation of score and forward return by date over rows that have both; null with fewer than `least`."""
    both = df.where(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    ranked = both.withColumn("_a", average_rank(score, *by)).withColumn("_b", average_rank(fwd, *by))
    return ranked.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= least, correlation(F.col("_a"), F.col("_b"))).alias("ic"), F.count(F.lit(1)).alias("n"))


def macro_tilt(macro: DataFrame, betas: DataFrame, series: list[str]) -> DataFrame:
    """(date, sector, tilt): the sum over series of a sector's beta times the series' z-score. macro: (date, one z a series);
    betas: (sector, beta_<series>...), a row a sector; dates on which a z is unknown have no tilt."""
    both = macro.where(" and ".join(f"{s} is not null" for s in series)).crossJoin(F.broadcast(betas))  # a row a sector
    return both.select("date", "sector", sum((F.col(f"beta_{s}") * F.col(s) for s in series), F.lit(0.0)).alias("tilt"))


def rotation(df: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    """Weighted sum of each column's z-score over the date's sectors, 0 for one without deviation; unknown values count 0."""
    total = F.lit(0.0)
    for c, weight in weights.items():
        x, s = F.coalesce(F.col(c), F.lit(0.0)), F.stddev_samp(F.coalesce(F.col(c), F.lit(0.0))).over(over())
        total = total + weight * F.when(s > 1e-8, (x - F.avg(x).over(over())) / s).otherwise(0.0)
    return df.withColumn(out, total)
