"""Technical indicators on bars (asset, date, n, open, high, low, close, volume); n numbers an asset's bars from 1.

Smoothings are seeded with the first value; EMA of n has alpha 2 / (n + 1), Wilder's average 1 / n.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.columns import safe_div


def bars_of():
    return Window.partitionBy("asset").orderBy("n")


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("n", F.row_number().over(Window.partitionBy("asset").orderBy("date")))


def last(n: int):
    return bars_of().rowsBetween(-n + 1, 0)


def full(c: Column, n: int) -> Column:
    """c where the asset has n bars by now."""
    return F.when(F.col("n") >= n, c)


def before(c: str, k: int = 1) -> Column:
    return F.lag(c, k).over(bars_of())


def smoothed(df: DataFrame, spans: dict[str, tuple[str, float]]) -> DataFrame:
    """df with, for each output, the recursion s = alpha * x + (1 - alpha) * s from (column, alpha), by asset and bar.

    A recursion over an ordered group has no built-in form; one group is one asset's bars.
    """

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("n")
        return bars.assign(**{out: bars[c].ewm(alpha=a, adjust=False).mean() for out, (c, a) in spans.items()})

    schema = T.StructType([*df.schema.fields, *[T.StructField(out, T.DoubleType()) for out in spans]])
    return df.groupBy("asset").applyInPandas(run, schema)


def ema(n: int) -> float:
    return 2 / (n + 1)


def movements(bars: DataFrame) -> DataFrame:
    """Bars with gain, loss, true range tr, directional moves up and down, and accumulation line ad."""
    change = F.col("close") - before("close")
    rise, fall = F.col("high") - before("high"), before("low") - F.col("low")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before("close")), F.abs(F.col("low") - before("close")))
    zero = F.lit(0.0)
    return bars.withColumns({
        "gain": F.coalesce(F.greatest(change, zero), zero),
        "loss": F.coalesce(F.greatest(-change, zero), zero),
        "tr": tr,
        "up": F.when((rise > fall) & (rise > 0), rise).otherwise(zero),
        "down": F.when((fall > rise) & (fall > 0), fall).otherwise(zero),
        "ad": F.sum(F.coalesce(clv(), zero) * F.col("volume")).over(bars_of().rowsBetween(Window.unboundedPreceding, 0)),
    })


def clv() -> Column:
    """Place of the close within the bar, from -1 to 1; null for a bar without range."""
    return safe_div(2 * F.col("close") - F.col("low") - F.col("high"), F.col("high") - F.col("low"))


def recursive_set(bars: DataFrame) -> DataFrame:
    """The indicators that rest on smoothing."""
    one = smoothed(movements(numbered(bars)), {
        "ema12": ("close", ema(12)), "ema26": ("close", ema(26)), "ema20": ("close", ema(20)),
        "g14": ("gain", 1 / 14), "l14": ("loss", 1 / 14), "g28": ("gain", 1 / 28), "l28": ("loss", 1 / 28),
        "atr": ("tr", 1 / 14), "up14": ("up", 1 / 14), "down14": ("down", 1 / 14), "ad3": ("ad", ema(3)), "ad10": ("ad", ema(10)),
    })
    total = F.col("up14") + F.col("down14")
    two = one.withColumn("macd", F.col("ema12") - F.col("ema26")).withColumn("dx", F.coalesce(100 * safe_div(F.abs(F.col("up14") - F.col("down14")), total), F.lit(0.0)))
    out = smoothed(two, {"signal": ("macd", ema(9)), "adx": ("dx", 1 / 14)})
    c = F.col("close")
    rsi = lambda n: F.coalesce(safe_div(F.col(f"g{n}"), F.col(f"g{n}") + F.col(f"l{n}")), F.lit(0.5))
    return out.select(
        "asset", "date",
        ((F.col("ema12") - c) / c).alias("ema_12"), ((F.col("ema26") - c) / c).alias("ema_26"),
        (F.col("macd") / c).alias("macd"), ((F.col("macd") - F.col("signal")) / c).alias("macd_hist"), (F.col("signal") / c).alias("macd_signal"),
        (F.col("adx") / 100).alias("adx"), rsi(14).alias("rsi_14"), rsi(28).alias("rsi_28"),
        (F.col("atr") / c).alias("atr"), ((F.col("ema20") + 2 * F.col("atr") - c) / c).alias("keltner_up"), ((F.col("ema20") - 2 * F.col("atr") - c) / c).alias("keltner_low"),
        (F.col("ad3") - F.col("ad10")).alias("adosc"),
    )


def window_set(bars: DataFrame) -> DataFrame:
    """The indicators that rest on frames of bars."""
    b = numbered(bars)
    c, h, low, v = F.col("close"), F.col("high"), F.col("low"), F.col("volume")
    b = b.withColumn("tp", (h + low + c) / 3)
    b = b.withColumns({
        "flow": F.signum(F.col("tp") - before("tp")),
        "k": 100 * safe_div(c - F.min("low").over(last(14)), F.max("high").over(last(14)) - F.min("low").over(last(14))),
        "obv": F.sum(F.coalesce(F.signum(c - before("close")), F.lit(0.0)) * v).over(bars_of().rowsBetween(Window.unboundedPreceding, 0)),
        "month": F.trunc("date", "month"),
    })
    b = b.withColumn("k3", F.avg("k").over(last(3)))
    tps = F.collect_list("tp").over(last(20))
    mean = F.avg("tp").over(last(20))
    deviation = F.aggregate(tps, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / 20
    pos = F.sum(F.when(F.col("flow") > 0, F.col("tp") * v).otherwise(0.0)).over(last(14))
    neg = F.sum(F.when(F.col("flow") < 0, F.col("tp") * v).otherwise(0.0)).over(last(14))
    sma, sd = F.avg("close").over(last(20)), F.stddev_pop("close").over(last(20))
    anchor = Window.partitionBy("asset", "month").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    pivot = before("tp")
    return b.select(
        "asset", "date",
        full(safe_div(F.col("tp") - mean, 0.015 * deviation), 20).alias("cci"),
        full(F.col("k3") / 100, 16).alias("stoch_k"), full(F.avg("k3").over(last(3)) / 100, 18).alias("stoch_d"),
        (c / before("close", 5) - 1).alias("roc_5"), (c / before("close", 21) - 1).alias("roc_21"), ((c - before("close", 14)) / c).alias("mom_14"),
        full((sma + 2 * sd - c) / c, 20).alias("bb_up"), full((sma - 2 * sd - c) / c, 20).alias("bb_low"), full(4 * sd / sma, 20).alias("bb_width"),
        safe_div(F.col("obv") - before("obv"), before("obv")).alias("obv_change"),
        ((F.sum(F.col("tp") * v).over(anchor) / F.sum("volume").over(anchor) - c) / c).alias("vwap"),
        full(F.coalesce(100 * safe_div(pos, pos + neg), F.lit(50.0)) / 100, 14).alias("mfi"),
        full(F.sum(F.coalesce(clv(), F.lit(0.0)) * v).over(last(20)) / F.sum("volume").over(last(20)), 20).alias("cmf"),
        ((pivot - c) / c).alias("pivot"), ((2 * pivot - before("low") - c) / c).alias("r1"), ((2 * pivot - before("high") - c) / c).alias("s1"),
        full((F.max("high").over(last(20)) - c) / c, 20).alias("don_up"), full((F.min("low").over(last(20)) - c) / c, 20).alias("don_low"),
    )


def indicator_panel(bars: DataFrame) -> DataFrame:
    """(asset, date, indicator, value) of both sets; unknown values are filled forward, then 0."""
    both = recursive_set(bars).join(window_set(bars), ["asset", "date"])
    long = both.unpivot(["asset", "date"], [x for x in both.columns if x not in ("asset", "date")], "indicator", "value")
    w = Window.partitionBy("asset", "indicator").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("value", F.coalesce(F.last("value", ignorenulls=True).over(w), F.lit(0.0)))
