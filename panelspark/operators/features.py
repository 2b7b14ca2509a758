"""The feature panel of stock models: technical features, the market's state, fundamentals as filed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import clip, safe_div
from panelspark.operators import windows as W
from panelspark.operators.joins import asof_join
from panelspark.operators.xsection import pct_rank
from panelspark.sources.shared import written

#: Rows of a week, a month, a quarter, half a year and a year, of breadth, and of the regression on the sector.
MONTHLY = {"week": 1, "month": 2, "quarter": 3, "half": 6, "year": 12, "breadth": 10, "fit": 24}
STOCK = ("idio_mom_1m", "idio_mom_3m", "idio_mom_6m", "total_mom_1m", "total_mom_3m", "reversal_1w", "vol_ratio", "beta", "mom_12_1", "high_52w_ratio", "rel_volume", "price_vol_corr")
MARKET = ("cs_dispersion", "breadth_200d")
FILED = ("eps_ttm", "eps_growth_yoy", "eps_acceleration", "eps_surprise", "eps_revision", "eps_revision_trend", "revenue_growth_yoy", "revenue_acceleration", "gross_margin", "gross_margin_expansion")


def sector_state(panel: DataFrame, n: dict[str, int]) -> DataFrame:
    """(sector, date, sec, sector_vol, sector_vol_pctile): mean return, and of the date before its deviation and that one's
    rank in the last year. One row a sector and date."""
    by = ("sector",)
    rows = panel.groupBy("sector", "date", "i").agg(F.avg("ret").alias("sec"))
    rows = rows.withColumn("_v", W.rolling(F.col("sec"), -n["half"] + 1, 0, F.stddev_samp, by=by))
    seen = F.collect_list("_v").over(W.frame(-n["year"] + 1, 0, by=by))
    less, same = (F.size(F.filter(seen, f)) for f in (lambda x: x < F.col("_v"), lambda x: x == F.col("_v")))
    rows = rows.withColumn("_p", F.when(F.col("_v").isNotNull() & (F.size(seen) >= n["quarter"]), (less + (same + 1) / 2) / F.size(seen)))
    return rows.select("sector", "date", "sec", W.lag("_v", 1, by=by).alias("sector_vol"), W.lag("_p", 1, by=by).alias("sector_vol_pctile"))


def market_state(panel: DataFrame, n: dict[str, int]) -> DataFrame:
    """(date, cs_dispersion, breadth_200d) of the date before: mean deviation across assets over a month, and the share of
    assets that gained over the breadth's rows. One row a date, so one ordered partition is enough."""
    up = F.when(W.rolling(F.col("ret"), -n["breadth"] + 1, 0, F.sum) > 0, 1.0).otherwise(0.0)
    days = panel.withColumn("_up", up).groupBy("date", "i").agg(F.stddev_samp("ret").alias("_d"), F.avg("_up").alias("_b"))
    w = Window.orderBy("i")
    month = w.rowsBetween(-n["month"] + 1, 0)
    days = days.withColumn("_m", F.when(F.count("_d").over(month) >= n["month"], F.avg("_d").over(month)))
    return days.select("date", F.lag("_m").over(w).alias("cs_dispersion"), F.lag("_b").over(w).alias("breadth_200d"))


def technical_features(panel: DataFrame, n: dict[str, int] = MONTHLY) -> DataFrame:
    """(asset, sector, date, close, volume, STOCK, MARKET, sector_vol_pctile, ipo_age_days), all but the age as
    of the row before. panel: dense (asset, sector, date, i, close, volume, ret)."""
    whole = W.frame(Window.unboundedPreceding, 0)
    df = panel.join(sector_state(panel, n), ["sector", "date"]).join(market_state(panel, n), "date")
    df = W.with_rolling_ols(df, "ret", "sec", n["fit"], n["year"]).withColumnRenamed("resid", "_e").drop("alpha")
    volume = F.greatest(F.last("volume", ignorenulls=True).over(whole), F.lit(1.0))
    df = df.withColumns({"_x": F.col("ret") - F.col("sec"), "_vol": volume, "_cum": F.when(F.col("ret").isNotNull(), F.exp(F.sum("ret").over(whole)))})
    df = written(df.withColumn("_lv", F.log("_vol")))
    df = df.withColumn("_dv", F.col("_lv") - W.lag("_lv", 1))
    total = lambda c, k: W.rolling(F.col(c), -n[k] + 1, 0, F.sum)
    mean = lambda k: W.rolling(F.col("_vol"), -n[k] + 1, 0, F.avg)
    df = df.withColumns({
        "idio_mom_1m": total("_e", "month"), "idio_mom_3m": total("_e", "quarter"), "idio_mom_6m": total("_e", "half"),
        "total_mom_1m": total("_x", "month"), "total_mom_3m": total("_x", "quarter"), "reversal_1w": total("ret", "week"),
        "mom_12_1": total("ret", "year") - total("ret", "month"),
        "_sd": W.rolling(F.col("ret"), -n["half"] + 1, 0, F.stddev_samp),
        "high_52w_ratio": clip(W.high_ratio("_cum", n["year"], n["quarter"]), 0.0, 1.0),
        "rel_volume": mean("month") / (mean("half") + 1e-6),
        "price_vol_corr": W.rolling_corr("ret", "_dv", n["half"]),
    })
    df = written(df)
    lagged = {c: W.lag(c, 1) for c in STOCK if c != "vol_ratio"} | {"vol_ratio": W.lag("_sd", 1) / (F.col("sector_vol") + 1e-8)}
    df = df.withColumns(lagged | {"ipo_age_days": W.age_days()})
    return df.select("asset", "sector", "date", "close", "volume", *STOCK, *MARKET, "sector_vol_pctile", "ipo_age_days")


def filed_features(quarters: DataFrame) -> DataFrame:
    """(asset, date, FILED) of quarters (asset, date, eps, sales, gross), date: when filed. The estimate of a quarter
    is the mean of up to four before it, two at least; revisions are changes of that estimate."""
    roll = lambda c, low, high, agg, least=None: W.rolling(F.col(c), low, high, agg, least, "date")
    ago = lambda c, k: W.lag(c, k, "date")
    change = lambda c, k: safe_div(F.col(c) - ago(c, k), F.abs(ago(c, k)))
    df = quarters.withColumns({"eps_ttm": roll("eps", -3, 0, F.sum), "_est": roll("eps", -4, -1, F.avg, 2)})
    df = df.withColumns({
        "eps_growth_yoy": clip(change("eps_ttm", 4), -2.0, 10.0),
        "eps_surprise": clip(safe_div(F.col("eps") - F.col("_est"), F.abs("_est")), -2.0, 2.0),
        "eps_revision": clip(change("_est", 1), -2.0, 2.0),
        "_s": F.signum(F.col("_est") - ago("_est", 1)),
        "revenue_growth_yoy": clip(change("sales", 4), -1.0, 5.0),
        "gross_margin": clip(safe_div(F.col("gross"), F.col("sales")), 0.0, 1.0),
    })
    df = df.withColumns({
        "eps_acceleration": F.col("eps_growth_yoy") - ago("eps_growth_yoy", 4),
        "eps_revision_trend": roll("_s", -3, 0, F.sum, 2),
        "revenue_acceleration": clip(F.col("revenue_growth_yoy") - ago("revenue_growth_yoy", 1), -3.0, 3.0),
        "gross_margin_expansion": clip(F.col("gross_margin") - ago("gross_margin", 4), -0.3, 0.3),
    })
    return df.select("asset", "date", *FILED)


def valuation(panel: DataFrame) -> DataFrame:
    """Panel (date, close, volume, eps_ttm, eps_growth_yoy, ...) with trailing_pe, peg_ratio, log_market_cap (close
    times volume, where shares are unknown) and pe_rank_cs."""
    pe = clip(F.when(F.col("eps_ttm") > 0, F.col("close") / F.col("eps_ttm")), 0.0, 200.0)
    df = panel.withColumns({"trailing_pe": pe, "log_market_cap": F.log(clip(F.col("close") * F.col("volume"), 1e6))})
    df = df.withColumn("peg_ratio", clip(F.try_divide(F.col("trailing_pe"), F.col("eps_growth_yoy") * 100), 0.0, 20.0))
    return df.withColumn("pe_rank_cs", pct_rank("trailing_pe"))


def feature_panel(technical: DataFrame, quarters: DataFrame) -> DataFrame:
    """Technical features, fundamentals as last filed and valuation, by asset and date."""
    return valuation(asof_join(technical, filed_features(quarters), ["asset"], "date", [*FILED]))
