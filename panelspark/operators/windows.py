"""Per-asset features over calendar rows of a dense panel (asset, i, ...), each frame strictly counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import correlation

BY_ASSET = ("asset",)


def frame(low: int, high: int, order: str = "i", by: tuple[str, ...] = BY_ASSET):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(low, high)


def ordered(order: str = "i", by: tuple[str, ...] = BY_ASSET):
    return Window.partitionBy(*by).orderBy(order)


def rolling(c: Column, low: int, high: int, agg, least: int | None = None, order: str = "i", by: tuple[str, ...] = BY_ASSET) -> Column:
    """Agg over rows low..high from this one, null unless at least `least` values are known (default: all rows)."""
    w = frame(low, high, order, by)
    return F.when(F.count(c).over(w) >= (high - low + 1 if least is None else least), agg(c).over(w))


def lag(c: Column | str, k: int, order: str = "i", by: tuple[str, ...] = BY_ASSET) -> Column:
    """The value k rows before (after, if negative)."""
    return F.lag(c, k).over(ordered(order, by))


def simple_return(close: str = "close") -> Column:
    """P / p before - 1."""
    return F.col(close) / lag(close, 1) - 1


def log_return(close: str = "close") -> Column:
    """Log of the ratio to the price before; prices of zero or less count as unknown."""
    p = F.when(F.col(close) > 0, F.col(close))
    before = lag(close, 1)
    return F.log(p / F.when(before > 0, before))


def momentum(skip: int, back: int, close: str = "close") -> Column:
    """Price `skip` rows ago over price `back` rows ago, less 1."""
    return lag(close, skip) / lag(close, back) - 1


def sum_momentum(ret: Column, back: int, skip: int, least: int | None = None) -> Column:
    """Sum of returns over the rows [t - back, t - skip)."""
    return rolling(ret, -back, -skip - 1, F.sum, least)


def realized_vol(ret: Column, n: int, per_year: float, least: int = 2) -> Column:
    """Annualised deviation over the last n rows; gaps are skipped."""
    return rolling(ret, -n + 1, 0, F.stddev_samp, least) * per_year**0.5


def past_vol(ret: Column, n: int, per_year: float, floor: float) -> Column:
    """Annualised deviation over the n rows before this one, at least `floor`."""
    v = rolling(ret, -n, -1, F.stddev_samp, 2) * per_year**0.5
    return F.when(v.isNotNull(), F.greatest(v, F.lit(floor)))


def downside_vol(ret: Column, n: int, per_year: float) -> Column:
    """Deviation of the losses, min(r, 0), scaled by sqrt(2)."""
    loss = F.when(ret.isNotNull(), F.least(ret, F.lit(0.0)))
    return rolling(loss, -n + 1, 0, F.stddev_samp) * (2 * per_year) ** 0.5


def trend_signal(lookbacks: list[int], close: str = "close") -> Column:
    """Mean over lookbacks of the sign of the price's change; an unknown one counts 0."""
    signs = [F.coalesce(F.signum(F.col(close) / lag(close, k) - 1), F.lit(0.0)) for k in lookbacks]
    return sum(signs[1:], signs[0]) / len(lookbacks)


def equity(ret: Column, by: tuple[str, ...], order: str = "date") -> Column:
    """Running product of 1 + r, for returns above -1; unknown returns count as 0."""
    return F.exp(F.sum(F.log1p(F.coalesce(ret, F.lit(0.0)))).over(frame(Window.unboundedPreceding, 0, order, by)))


def drawdown(df: DataFrame, ret: str, by: tuple[str, ...], order: str = "date") -> DataFrame:
    """Df with equity and drawdown from its running peak, which does not count the initial 1."""
    out = df.withColumn("equity", equity(F.col(ret), by, order))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(frame(Window.unboundedPreceding, 0, order, by)) - 1)


def hold_returns(df: DataFrame, ret: str, every: int) -> DataFrame:
    """(asset, hold, hold_ret): compounded return of rows (k * every, (k + 1) * every]; unknown days are skipped."""
    hold = df.withColumn("hold", F.floor((F.col("i") - 1) / every))
    return hold.where("i >= 1").groupBy("asset", "hold").agg((F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))) - 1).alias("hold_ret"))


def rolling_ols(y: str, x: str, n: int, least: int) -> dict[str, Column]:
    """Alpha, beta over the n rows before this one (from `least` rows on), and the residual of this row."""
    w = frame(-n, -1)
    both = F.count(F.when(F.col(y).isNotNull(), F.col(x))).over(w)
    enough = (both >= least) & (F.var_samp(F.when(F.col(y).isNotNull(), F.col(x))).over(w) > 1e-12)
    beta = F.when(enough, F.regr_slope(y, x).over(w))
    alpha = F.when(enough, F.regr_intercept(y, x).over(w))
    return {"alpha": alpha, "beta": beta, "resid": F.col(y) - alpha - beta * F.col(x)}


def with_rolling_ols(df: DataFrame, y: str, x: str, n: int, least: int) -> DataFrame:
    """df with alpha, beta and resid of rolling_ols. Each sum over the rows is a column that the three share: Spark would evaluate it again
    for each expression that names it."""
    w = frame(-n, -1)
    of_x, of_y = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    sums = {"_n": F.count(of_x), "_var": F.var_samp(of_x), "_cov": F.covar_samp(y, x), "_mx": F.avg(of_x), "_my": F.avg(of_y)}
    both = df.withColumns({c: v.over(w) for c, v in sums.items()})
    both = both.withColumn("beta", F.when((F.col("_n") >= least) & (F.col("_var") > 1e-12), F.col("_cov") / F.col("_var")))
    both = both.withColumn("alpha", F.col("_my") - F.col("beta") * F.col("_mx"))
    return both.withColumn("resid", F.col(y) - F.col("alpha") - F.col("beta") * F.col(x)).drop(*sums)


def forward_sum(c: Column, h: int) -> Column:
    """Sum of the next h rows, all of them known."""
    return rolling(c, 1, h, F.sum)


def pctile_rank(c: str, n: int, least: int) -> Column:
    """Average rank of this value among the last n rows' known values, over their number."""
    seen = F.collect_list(c).over(frame(-n + 1, 0))
    less = F.size(F.filter(seen, lambda x: x < F.col(c)))
    same = F.size(F.filter(seen, lambda x: x == F.col(c)))
    return F.when(F.col(c).isNotNull() & (F.size(seen) >= least), (less + (same + 1) / 2) / F.size(seen))


def rolling_corr(x: str, y: str, n: int) -> Column:
    """Correlation over the last n rows, all pairs known."""
    w = frame(-n + 1, 0)
    return F.when(F.count(F.when(F.col(y).isNotNull(), F.col(x))).over(w) >= n, correlation(F.col(x), F.col(y), w))


def relative_volume(volume: str, short: int, long: int) -> Column:
    """W19 without its lag: short mean over long mean of volume, at least 1 each row."""
    v = F.when(F.col(volume).isNotNull(), F.greatest(F.col(volume), F.lit(1.0)))
    return rolling(v, -short + 1, 0, F.avg) / (rolling(v, -long + 1, 0, F.avg) + 1e-6)


def high_ratio(close: str, n: int, least: int) -> Column:
    """W20 without its lag: the price over its highest of n rows."""
    return F.col(close) / rolling(F.col(close), -n + 1, 0, F.max, least)


def age_days(date: str = "date", value: str = "close") -> Column:
    """Days since the asset's first value; null on that day and before."""
    first = F.min(F.when(F.col(value).isNotNull(), F.col(date))).over(Window.partitionBy("asset"))
    age = F.datediff(date, first)
    return F.when(age > 0, age)


def trailing_z(c: str, n: int, least: int, order: str = "date", by: tuple[str, ...] = ()) -> Column:
    """(x - mean) / (std + 1e-8) over the last n rows, this one included."""
    x = F.col(c)
    return (x - rolling(x, -n + 1, 0, F.avg, least, order, by)) / (rolling(x, -n + 1, 0, F.stddev_samp, least, order, by) + 1e-8)


def ttm_sum(val: str, n: int, order: str, partial: str = "annualise") -> Column:
    """Sum of the last n filings; of fewer the sum times n over their number, or the plain sum."""
    w = frame(-n + 1, 0, order)
    total, known = F.sum(val).over(w), F.count(val).over(w)
    return total * n / known if partial == "annualise" else total


def sue(eps: str, order: str, season: int = 4, n: int = 8, least: int = 4, most: float = 8.0) -> dict[str, Column]:
    """W25 by steps: seasonal change, its deviation (zero as null), and their ratio clipped to +-most."""
    change = F.col(eps) - lag(eps, season, order)
    deviation = F.col("deviation")
    return {
        "change": change,
        "deviation": rolling(F.col("change"), -n + 1, 0, F.stddev_samp, least, order),
        "sue": F.when(deviation != 0, F.greatest(F.least(F.col("change") / deviation, F.lit(most)), F.lit(-most))),
    }


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes last by the order; the order must not tie."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[o.desc() for o in order]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def adv_dollar(n: int, least: int) -> Column:
    """Mean of price times volume over the last n rows."""
    return rolling(F.col("close") * F.col("volume"), -n + 1, 0, F.avg, least)


def expanding_std(c: Column, least: int, by: tuple[str, ...], order: str = "date") -> Column:
    """Deviation of all rows before this one, from `least` of them on."""
    w = frame(Window.unboundedPreceding, -1, order, by)
    return F.when(F.count(c).over(w) >= least, F.stddev_samp(c).over(w))


def multi_horizon(ret: str, most: int) -> Column:
    """Array of the compounded returns of this row and the next 0..most-1, each null unless all are known."""
    each = []
    for k in range(1, most + 1):
        w = frame(0, k - 1)
        each.append(F.when(F.count(ret).over(w) == k, F.exp(F.sum(F.log1p(ret)).over(w)) - 1))
    return F.array(*each)


def decay_fill(c: str, rate: float) -> Column:
    """The last value that is not zero, times rate to the number of rows since; 0 before any."""
    last = F.last(F.when(F.col(c) != 0, F.struct(F.col(c).alias("v"), F.col("i").alias("at"))), ignorenulls=True).over(frame(Window.unboundedPreceding, 0))
    return F.coalesce(last["v"] * F.pow(F.lit(rate), (F.col("i") - last["at"]).cast("double")), F.lit(0.0))
