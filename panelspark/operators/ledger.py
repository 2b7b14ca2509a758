"""Turnover, book returns and capital ledgers from (date, asset, w) and forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turnover(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., date, turnover): sum of |w - w before| over names of either of two consecutive books.

    A name that enters or leaves counts in full; the first book counts its gross. Each weight meets its
    predecessor in the book before by its number, so no grid of names and dates is made.
    """
    keys = [*by, "date"]
    order = Window.partitionBy(*by).orderBy("date") if by else Window.orderBy("date")
    books = weights.select(*keys).distinct().withColumn("k", F.row_number().over(order))
    numbered = weights.join(books, keys)
    now = numbered.select(*by, "k", "asset", F.col("w").alias("a"))
    before = numbered.select(*by, (F.col("k") + 1).alias("k"), "asset", F.col("w").alias("b"))
    moved = now.join(before, [*by, "k", "asset"], "full").groupBy(*by, "k").agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("turnover"))
    return moved.join(books, [*by, "k"]).select(*keys, "turnover")


def book_return(weights: DataFrame, fwd: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., date, ret, long_ret, short_ret, n_long, n_short, gross, short_gross); a missing forward return counts 0."""
    rows = weights.join(fwd.select("date", "asset", "fwd_ret"), ["date", "asset"], "left").withColumn("_c", F.col("w") * F.coalesce("fwd_ret", F.lit(0.0)))
    part = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    return rows.groupBy(*by, "date").agg(
        F.sum("_c").alias("ret"),
        part(F.col("w") > 0, F.col("_c")).alias("long_ret"),
        part(F.col("w") < 0, F.col("_c")).alias("short_ret"),
        F.count(F.when(F.col("w") > 0, 1)).alias("n_long"),
        F.count(F.when(F.col("w") < 0, 1)).alias("n_short"),
        F.sum(F.abs("w")).alias("gross"),
        part(F.col("w") < 0, -F.col("w")).alias("short_gross"),
    )


def portfolio_ledger(weights: DataFrame, fwd: DataFrame, rows_held: Column, tcost: float, borrow: float, capital: float = 1e6, per_year: float = 252.0) -> DataFrame:
    """One row a rebalance: period_return is net of borrowing and gross of trading costs, which hit capital
    only; capital is the running product of (1 - turnover * tcost) * (1 + period_return)."""
    rows = book_return(weights, fwd).join(turnover(weights), "date").join(fwd.groupBy("date").agg(F.max(rows_held).alias("held")), "date")
    rows = rows.withColumn("borrow_cost", borrow * F.col("held") / per_year * F.col("short_gross"))
    rows = rows.withColumn("period_return", F.col("ret") - F.col("borrow_cost"))
    step = F.log1p(-F.col("turnover") * tcost) + F.log1p("period_return")
    path = F.exp(F.sum(step).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("capital", capital * path)


def perf_stats(returns: DataFrame, ppy: float, by: tuple[str, ...], ret: str = "ret") -> DataFrame:
    """Total, sharpe, vol, max_dd and n by strategy; sharpe is null without deviation, and all but n with fewer than two rows."""
    from panelspark.operators.windows import drawdown

    rows = drawdown(returns.where(F.col(ret).isNotNull()), ret, by)
    s = F.stddev_samp(ret)
    two = F.count(F.lit(1)) >= 2
    return rows.groupBy(*by).agg(
        F.when(two, F.product(1 + F.col(ret)) - 1).alias("total"),
        F.when(two & (s > 0), F.avg(ret) / s * ppy**0.5).alias("sharpe"),
        F.when(two, s * ppy**0.5).alias("vol"),
        F.when(two, F.min("drawdown")).alias("max_dd"),
        F.count(F.lit(1)).alias("n"),
    )


def ic_summary(ics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A10: mean, information ratio, t and hit rate of known ICs."""
    s = F.stddev_samp("ic")
    ir = F.when(s > 0, F.avg("ic") / s)
    return ics.where("ic is not null").groupBy(*by).agg(F.avg("ic").alias("mean_ic"), ir.alias("ir"), (ir * F.sqrt(F.count(F.lit(1)))).alias("t"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("hit"), F.count(F.lit(1)).alias("n"))


def cost_grid(net: DataFrame, bps: list[float], ppy: float) -> DataFrame:
    """(bps, mean_ret, sharpe) of ret - turnover * bps, for each cost of a list; rows meet the list by expansion."""
    each = net.select("ret", "turnover", F.explode(F.array(*map(F.lit, bps))).alias("bps")).withColumn("r", F.col("ret") - F.col("turnover") * F.col("bps") / 1e4)
    s = F.stddev_samp("r")
    return each.groupBy("bps").agg((F.avg("r") * ppy).alias("mean_ret"), F.when(s > 0, F.avg("r") / s * ppy**0.5).alias("sharpe"))


def capacity_curve(weights: DataFrame, adv: DataFrame, net: DataFrame, aum: list[float], c: float, sigma: float, ppy: float) -> DataFrame:
    """(aum, mean_ret, sharpe): returns less square-root impact of each trade; a name without ADV has none."""
    keys = Window.orderBy("date")
    books = weights.select("date").distinct().withColumn("k", F.row_number().over(keys))
    numbered = weights.join(books, "date")
    before = numbered.select((F.col("k") + 1).alias("k"), "asset", F.col("w").alias("b"))
    trades = numbered.select("k", "asset", F.col("w").alias("a")).join(before, ["k", "asset"], "full").join(books, "k")
    trades = trades.select("date", "asset", F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("d")).join(adv, ["date", "asset"], "left")
    each = trades.select("date", "d", "adv", F.explode(F.array(*map(F.lit, aum))).alias("aum"))
    drag = each.groupBy("date", "aum").agg(F.sum(F.coalesce(F.when(F.col("adv") > 0, F.col("d") * c * sigma * F.sqrt(F.col("d") * F.col("aum") / F.col("adv"))), F.lit(0.0))).alias("drag"))
    r = drag.join(net.select("date", "ret"), "date").withColumn("r", F.col("ret") - F.col("drag"))
    s = F.stddev_samp("r")
    return r.groupBy("aum").agg((F.avg("r") * ppy).alias("mean_ret"), F.when(s > 0, F.avg("r") / s * ppy**0.5).alias("sharpe"), F.avg("drag").alias("mean_drag"))


def extended_perf(df: DataFrame, ret: str, bench: str, ppy: float, by: tuple[str, ...]) -> DataFrame:
    """(by..., total, bench_total, excess, annual, info_ratio, hit) of returns beside a benchmark's; nothing for fewer than four rows."""
    active = F.col(ret) - F.col(bench)
    total, other = F.product(1 + F.col(ret)), F.product(1 + F.col(bench))
    facts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        (total - 1).alias("total"),
        (other - 1).alias("bench_total"),
        (total - other).alias("excess"),
        (F.pow(total, ppy / F.count(F.lit(1))) - 1).alias("annual"),
        (F.avg(active) / F.stddev_samp(active) * ppy**0.5).alias("info_ratio"),
        F.avg(F.when(active > 0, 1.0).otherwise(0.0)).alias("hit"),
    )
    return facts.where("_n >= 4").drop("_n")


def ledger_perf(rows: DataFrame, ppy: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., statistic...) of ledgers (date, period_return, capital, benchmark_return, turnover, gross, cost, long_ret, ic, vol):
    returns of capital and benchmark, Sharpe and information ratio, drawdown, ICs and their hit rate over known ones, sums of
    long returns and costs, means of turnover, gross exposure and volatility. Nothing for fewer than four rows or no deviation.
    """
    peak = F.max("capital").over(Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    r, bench = F.col("period_return"), F.product(1 + F.col("benchmark_return")) - 1
    active = r - F.col("benchmark_return")
    total = F.max_by("capital", "date") / F.min_by("capital", "date") - 1
    s, n = F.stddev_samp(r), F.count(F.lit(1))
    found = rows.withColumn("_down", F.col("capital") / peak - 1).groupBy(*by).agg(
        n.alias("n"), s.alias("_s"), total.alias("total"), bench.alias("bench_total"), (total - bench).alias("excess"), (F.pow(1 + total, ppy / n) - 1).alias("annual"), (F.avg(r) / s * ppy**0.5).alias("sharpe"),
        F.when(F.stddev_samp(active) > 1e-10, F.avg(active) / F.stddev_samp(active) * ppy**0.5).otherwise(0.0).alias("info_ratio"), F.min("_down").alias("max_dd"),
        F.avg("ic").alias("mean_ic"), F.avg(F.when(F.col("ic").isNotNull(), F.when(F.col("ic") > 0, 1.0).otherwise(0.0))).alias("ic_hit"),
        F.sum("long_ret").alias("long_total"), F.sum("cost").alias("total_cost"), F.avg("turnover").alias("avg_turnover"), F.avg("gross").alias("avg_gross"), F.avg("vol").alias("avg_vol"),
    )
    return found.where("n >= 4 and _s >= 1e-10").drop("_s")


def benchmark_windows(dense: DataFrame, asset, freq: int) -> DataFrame:
    """(date, i, log_return, simple_return) of one asset's next freq rows, fewer at the calendar's end: the sum of log
    returns, which skips unknown ones, and the change from price to price. One row a date, so one ordered partition."""
    w = Window.orderBy("i")
    one = dense.where(F.col("asset") == asset).withColumn("_l", F.log(F.col("close") / F.lag("close").over(w)))
    ahead = w.rowsBetween(1, freq)
    end = F.coalesce(F.lead("close", freq).over(w), F.last("close").over(w.rowsBetween(0, Window.unboundedFollowing)))
    return one.select("date", "i", F.coalesce(F.sum("_l").over(ahead), F.lit(0.0)).alias("log_return"), (end / F.col("close") - 1).alias("simple_return"))


def segment_changes(stats: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """(by, metric, dev, oos, diff, share) of statistics by segment: what each metric is out of sample less what it was in
    it, and that over its size in sample; null where that is 0."""
    long = stats.unpivot([by, "segment"], metrics, "metric", "value")
    wide = long.groupBy(by, "metric").pivot("segment", ["dev", "oos"]).agg(F.first("value"))
    diff = F.col("oos") - F.col("dev")
    return wide.select(by, "metric", "dev", "oos", diff.alias("diff"), F.when(F.col("dev") != 0, diff / F.abs("dev")).alias("share"))
