"""Books of weights from scores, by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, score: str) -> DataFrame:
    """Scored rows with _top and _bottom (places from the best and from the worst; ties by asset) and _n."""
    w = Window.partitionBy("date")
    rows = df.where(F.col(score).isNotNull())
    return rows.withColumns({
        "_top": F.row_number().over(w.orderBy(F.col(score).desc(), F.col("asset"))),
        "_bottom": F.row_number().over(w.orderBy(F.col(score), F.col("asset").desc())),
        "_n": F.count(F.lit(1)).over(w),
    })


def side(n: str, q: float) -> Column:
    """A-7: names on one side: floor(n * q), one at least."""
    return F.greatest(F.lit(1), F.floor(F.col(n) * q + 1e-9).cast("int"))


def long_short(df: DataFrame, score: str, q: float = 0.2, least: int = 10, leg_gross: float = 1.0) -> DataFrame:
    """(date, asset, w): +leg_gross/k for the k best, -leg_gross/k for the k worst; no book under `least` names."""
    p = placed(df, score).where(F.col("_n") >= least).withColumn("_k", side("_n", q))
    w = F.when(F.col("_top") <= F.col("_k"), leg_gross / F.col("_k")).when(F.col("_bottom") <= F.col("_k"), -leg_gross / F.col("_k"))
    return p.withColumn("w", w).where("w is not null").select("date", "asset", "w")


def long_only(df: DataFrame, score: str, q: float = 0.2, least: int = 10) -> DataFrame:
    """(date, asset, w): 1/k for the k best."""
    return long_short(df, score, q, least).where("w > 0")


def top_bottom(df: DataFrame, score: str, n: int) -> DataFrame:
    """(date, longs, shorts): names of the n best and n worst, best and worst first, joined by |."""
    p = placed(df, score).where(F.col("_n") >= 2 * n)

    def names(place: str) -> Column:
        picked = F.array_sort(F.collect_list(F.when(F.col(place) <= n, F.struct(F.col(place), F.col("asset").cast("string").alias("a")))))
        return F.array_join(F.transform(picked, lambda x: x["a"]), "|")

    return p.groupBy("date").agg(names("_top").alias("longs"), names("_bottom").alias("shorts"))


def topk(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each date by the order, equally weighted."""
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy(*order))).where(F.col("_r") <= k).drop("_r")
    return r.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("date")))


def inverse_vol_size(signal: Column, vol: Column, target: float, most: float) -> Column:
    """Signal * target / vol within +-most; 0 where that is unknown."""
    x = F.when(vol > 0, signal * target / vol)
    return F.coalesce(F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(most)), F.lit(-most))), F.lit(0.0))


def vol_target(ret: Column, target: float, most: float, least: int, per_year: float, by: tuple[str, ...], order: str = "date") -> Column:
    """Leverage from the deviation of all past returns, at most `most`; 1 until `least` of them."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    s = F.stddev_samp(ret).over(w)
    ready = (F.count(ret).over(w) >= least) & (s > 0)
    return F.when(ready, F.least(target / (s * per_year**0.5), F.lit(most))).otherwise(1.0)


def rank_invvol(df: DataFrame, score: str, vol: str, n: int, penalty: float, target: float, low: float, high: float, cap: float) -> DataFrame:
    """The n best by average rank, sized by (score rank) * (inverse vol over its mean) ** penalty, made to sum to
    clip(target / mean vol, low, high), capped once at `cap`, then made to sum to that again. A missing vol is the mean."""
    d = Window.partitionBy("date")
    rows = placed(df, score).where(F.col("_top") <= n)
    rows = rows.withColumn("_v", F.coalesce(F.col(vol), F.avg(vol).over(d)))
    rows = rows.withColumn("_s", (F.count(F.lit(1)).over(d) - F.col("_top") + 1) * F.pow((1 / F.col("_v")) / F.avg(1 / F.col("_v")).over(d), F.lit(penalty)))
    rows = rows.withColumn("_g", F.greatest(F.least(target / F.avg("_v").over(d), F.lit(high)), F.lit(low)))
    rows = rows.withColumn("_w", F.least(F.col("_s") / F.sum("_s").over(d) * F.col("_g"), F.lit(cap)))
    return rows.withColumn("w", F.col("_w") / F.sum("_w").over(d) * F.col("_g")).select("date", "asset", "w")


def position_limits(weights: DataFrame, most: float, long_only: bool = False) -> DataFrame:
    """Weights within +-most (or 0..most), scaled down if their gross is above 1."""
    w = F.greatest(F.least(F.col("w"), F.lit(most)), F.lit(0.0 if long_only else -most))
    gross = F.sum(F.abs("w")).over(Window.partitionBy("date"))
    return weights.withColumn("w", w).withColumn("w", F.col("w") / F.greatest(gross, F.lit(1.0)))


def decile_spread(df: DataFrame, score: str, fwd: str, q: float) -> DataFrame:
    """(date, spread): mean forward return of the k best less that of the k worst."""
    p = placed(df.where(F.col(fwd).isNotNull()), score).withColumn("_k", side("_n", q))
    top, bottom = F.avg(F.when(F.col("_top") <= F.col("_k"), F.col(fwd))), F.avg(F.when(F.col("_bottom") <= F.col("_k"), F.col(fwd)))
    return p.groupBy("date").agg((top - bottom).alias("spread"))


def two_layer(groups: DataFrame, names: DataFrame, group: str, least: float = 0.01) -> DataFrame:
    """(date, group, asset, w): each name's weight within its group times the group's weight, made to sum to what all groups of the
    date sum to. groups: (date, group, weight), of which those under `least` are cut; names: (date, group, asset, within)."""
    d = Window.partitionBy("date")
    layer = groups.withColumn("_all", F.sum("weight").over(d)).where(F.col("weight") >= least)
    rows = names.join(layer, ["date", group]).withColumn("_w", F.col("weight") * F.col("within"))
    return rows.withColumn("w", F.col("_w") / F.sum("_w").over(d) * F.col("_all")).select("date", group, "asset", "w")


def inverse_vol_within(df: DataFrame, score: str, vol: str, group: str, q: float, low: float) -> DataFrame:
    """(date, group, asset, within): the best share q of each group by score (ties by asset), weighed by one over their
    volatility, at least `low`; a missing one is the mean of the date's group."""
    g = Window.partitionBy("date", group)
    rows = df.where(F.col(score).isNotNull()).withColumns({"_t": F.row_number().over(g.orderBy(F.col(score).desc(), "asset")), "_n": F.count(F.lit(1)).over(g)})
    rows = rows.where(F.col("_t") <= side("_n", q)).withColumn("_i", 1 / F.greatest(F.coalesce(F.col(vol), F.avg(vol).over(g), F.lit(low)), F.lit(low)))
    return rows.select("date", group, "asset", (F.col("_i") / F.sum("_i").over(g)).alias("within"))


def signal_report(weights: DataFrame, least: float = 0.001) -> DataFrame:
    """(date, gross, net, n_long, long_total, n_short, short_total, longs, shorts) of books: exposures, and the names beyond
    `least` of either side, heaviest first, joined by |. A date's list is a book's names."""
    w = F.col("w")
    rows = weights.withColumns({"_l": w > least, "_s": w < -least})
    total = lambda on: F.coalesce(F.sum(F.when(F.col(on), w)), F.lit(0.0))

    def names(on: str, size: Column) -> Column:
        picked = F.array_sort(F.collect_list(F.when(F.col(on), F.struct(size.alias("k"), F.col("asset").alias("a")))))
        return F.array_join(F.transform(picked, lambda x: x["a"].cast("string")), "|")

    return rows.groupBy("date").agg(
        F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.count(F.when(F.col("_l"), 1)).alias("n_long"), total("_l").alias("long_total"),
        F.count(F.when(F.col("_s"), 1)).alias("n_short"), total("_s").alias("short_total"), names("_l", -w).alias("longs"), names("_s", w).alias("shorts"),
    )
