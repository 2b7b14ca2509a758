"""Risk of return series by group."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators import windows
from panelspark.operators.selection import exact_quantiles
from panelspark.sources.shared import written


def var_historical(r: str, conf: float) -> Column:
    """Loss not exceeded with probability conf, interpolated."""
    return -F.percentile(r, F.lit(1 - conf))


def var_parametric(r: str, conf: float) -> Column:
    """The same of a normal distribution (population deviation)."""
    return -(F.avg(r) + NormalDist().inv_cdf(1 - conf) * F.stddev_pop(r))


def var_cornish_fisher(r: str, conf: float) -> Column:
    """R02 with the quantile corrected for population skewness and excess kurtosis."""
    z = NormalDist().inv_cdf(1 - conf)
    s, k = F.skewness(r), F.kurtosis(r)
    q = z + (z**2 - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    return -(F.avg(r) + q * F.stddev_pop(r))


def cvar(df: DataFrame, r: str, by: list[str], conf: float) -> DataFrame:
    """(by..., cvar): mean loss of returns at or below -VaR."""
    q = df.withColumn("_q", F.percentile(r, F.lit(1 - conf)).over(Window.partitionBy(*by)))
    return q.groupBy(*by).agg(F.coalesce(-F.avg(F.when(F.col(r) <= F.col("_q"), F.col(r))), -F.first("_q")).alias("cvar"))


def ratios(r: str, ppy: float, bench: str, drawdown: str, threshold: float = 0.0) -> dict[str, Column]:
    """Sharpe, sortino (deviation of the losses alone, those beyond rounding), omega, calmar and information ratio over a benchmark's
    returns, with population deviations and 1e-8 under each line."""
    active = F.col(r) - F.col(bench)
    return {
        "sharpe": F.avg(r) / (F.stddev_pop(r) + 1e-8) * ppy**0.5,
        "sortino": F.avg(r) / F.sqrt(F.coalesce(F.avg(F.when(F.col(r) < -1e-12, F.col(r) * F.col(r))), F.lit(0.0)) + 1e-8) * ppy**0.5,
        "omega": F.sum(F.greatest(F.col(r) - threshold, F.lit(0.0))) / (F.sum(F.greatest(threshold - F.col(r), F.lit(0.0))) + 1e-8),
        "calmar": F.avg(r) * ppy / (F.abs(F.min(drawdown)) + 1e-8),
        "information_ratio": F.avg(active) / (F.stddev_pop(active) + 1e-8) * ppy**0.5,
    }


def beta(r: str, bench: str) -> Column:
    """Sample covariance over population variance plus 1e-8."""
    return F.covar_samp(r, bench) / (F.var_pop(bench) + 1e-8)


def risk_report(df: DataFrame, r: str, bench: str, by: list[str], ppy: float, confs: list[float]) -> DataFrame:
    """(by..., metric, value): return, volatility, drawdown, shape, ratios, beta, and VaR and CVaR at each confidence.

    One window a series for drawdown and quantiles, then one aggregation; rows without a return have no part.
    """
    name = lambda m, c: f"{m}_{round(100 * c)}"
    rows = windows.drawdown(df.where(F.col(r).isNotNull()), r, tuple(by))
    rows = rows.withColumns({name("_q", c): F.percentile(r, F.lit(1 - c)).over(Window.partitionBy(*by)) for c in confs})
    cols = {
        "annualized_return": F.avg(r) * ppy,
        "annualized_vol": F.stddev_pop(r) * ppy**0.5,
        "max_drawdown": F.min("drawdown"),
        "skewness": F.skewness(r),
        "kurtosis": F.kurtosis(r),
        "beta": beta(r, bench),
        **ratios(r, ppy, bench, "drawdown"),
        **{name(m, c): f(r, c) for c in confs for m, f in (("var_hist", var_historical), ("var_param", var_parametric), ("var_cf", var_cornish_fisher))},
        **{name("cvar", c): F.coalesce(-F.avg(F.when(F.col(r) <= F.col(name("_q", c)), F.col(r))), -F.first(name("_q", c))) for c in confs},
    }
    return rows.groupBy(*by).agg(*[v.alias(k) for k, v in cols.items()]).unpivot(by, [*cols], "metric", "value")


def value_curve_stats(df: DataFrame, value: str, by: list[str], ppy: float) -> DataFrame:
    """(by..., total, annualized, sharpe, max_dd, vol, final) of a curve of values by date; n values have n - 1 returns."""
    w = Window.partitionBy(*by).orderBy("date")
    rows = df.withColumn("_r", F.col(value) / F.lag(value).over(w) - 1).withColumn("_d", F.col(value) / F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    growth = F.max_by(value, "date") / F.min_by(value, "date")
    return rows.groupBy(*by).agg(
        (growth - 1).alias("total"),
        (F.pow(growth, ppy / F.count("_r")) - 1).alias("annualized"),
        (F.avg("_r") / (F.stddev_pop("_r") + 1e-8) * ppy**0.5).alias("sharpe"),
        F.min("_d").alias("max_dd"),
        (F.stddev_pop("_r") * ppy**0.5).alias("vol"),
        F.max_by(value, "date").alias("final"),
    )


def path_statistics(paths: DataFrame) -> DataFrame:
    """Mean, std (population), median, percentiles, share above 0 and mean of the worst 5 % of the paths' sums. Quantiles
    are selected from ranges of the sums; everything else is one row of combined sums."""
    sums = written(paths.groupBy("sim").agg(F.sum("ret").alias("s")))
    names = {0.01: "p1", 0.05: "p5", 0.5: "median", 0.95: "p95"}
    q = exact_quantiles(sums, "s", [], [*names]).agg(*[F.max(F.when(F.col("level") == level, F.col("value"))).alias(n) for level, n in names.items()])
    q = written(q)  # one row, used twice
    facts = sums.agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.avg(F.when(F.col("s") > 0, 1.0).otherwise(0.0)).alias("p_up"))
    tail = sums.join(F.broadcast(q.select("p5"))).where("s <= p5").agg((-F.avg("s")).alias("es95"))
    return facts.join(F.broadcast(q)).join(F.broadcast(tail)).select("mean", "std", "median", "p1", "p5", "p95", "p_up", "es95")


def confidence_bands(paths: DataFrame, levels: list[float]) -> DataFrame:
    """(step, level, value): quantiles over paths of the running sum, selected from ranges of each step's sums."""
    run = paths.withColumn("c", F.sum("ret").over(Window.partitionBy("sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    return exact_quantiles(run, "c", ["step"], levels)


def cov_table(df: DataFrame, key: str, r: str, per_year: float) -> DataFrame:
    """(a, b, cov): annualised sample covariance of all pairs of series, over dates that both have."""
    left, right = df.select("date", F.col(key).alias("a"), F.col(r).alias("x")), df.select("date", F.col(key).alias("b"), F.col(r).alias("y"))
    return left.join(right, "date").groupBy("a", "b").agg((F.covar_samp("x", "y") * per_year).alias("cov"))


def portfolio_variance(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """w' cov w for weights (key, w)."""
    wa, wb = weights.select(F.col("key").alias("a"), F.col("w").alias("wa")), weights.select(F.col("key").alias("b"), F.col("w").alias("wb"))
    return cov.join(wa, "a").join(wb, "b").agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("variance"))
