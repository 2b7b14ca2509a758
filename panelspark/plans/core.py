"""Queries: panel features, cross-sections, books and ledgers on the monthly panel of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.columns import clip, row_mean, safe_div
from panelspark.operators import calendar as C
from panelspark.operators import clean as P
from panelspark.operators import construct as K
from panelspark.operators import ledger as L
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.plans import fixtures as fx
from panelspark.plans.fixtures import CTE, sql
from panelspark.plans.registry import query
from panelspark.sources.shared import written

D = 8


def rounded(df: DataFrame, *keys: str, d: int = D, **values) -> DataFrame:
    """Keys, and values rounded; -0.0 becomes 0.0."""
    return df.select(*keys, *[(F.round(v if not isinstance(v, str) else F.col(v), d) + 0.0).alias(k) for k, v in values.items()])


def ret_m(spark: SparkSession, sf: str) -> DataFrame:
    return fx.dense_m(spark, sf).withColumn("ret", W.simple_return())


def ret_d(spark: SparkSession, sf: str) -> DataFrame:
    return P.ffill_limit(fx.dense_d(spark, sf), 5).withColumn("ret", clip(W.simple_return(), -0.15, 0.15))


CTE["fill_d"] = ("dense_d", "select asset, date, i, volume, case when i - max(case when close is not null then i end) over w <= 5 then last_value(close ignore nulls) over w end as close from dense_d window w as (partition by asset order by i rows unbounded preceding)")
CTE["rd"] = ("fill_d", "select *, case when r is not null then least(greatest(r, -0.15), 0.15) end as ret from (select *, close / lag(close) over (partition by asset order by i) - 1 as r from fill_d)")


def scores(spark: SparkSession, sf: str, rets: DataFrame | None = None) -> DataFrame:
    """Monthly rows with a sector, three factors and the next month's return; rets: the returns, where a caller has them."""
    df = (ret_m(spark, sf) if rets is None else rets).withColumns({"mom": W.momentum(1, 12), "low_vol": -W.rolling(F.col("ret"), -11, 0, F.stddev_samp, 6), "size": -F.log(F.col("close") * F.col("volume"))})
    df = C.forward_price(df, 1).withColumn("fwd_ret", clip(F.col("fwd_close") / F.col("close") - 1, -0.5, 0.5))
    return df.join(fx.sector_of(spark, sf), "asset").select("date", "i", "asset", "sector", "close", "volume", "mom", "low_vol", "size", "fwd_ret")


CTE["scores"] = (
    "ret_m sector_of",
    """select a.date, a.i, a.asset, s.sector, a.close, a.volume, a.mom, a.low_vol, -ln(a.close * a.volume) as size,
    case when f.close / a.close - 1 is not null then least(greatest(f.close / a.close - 1, -0.5), 0.5) end as fwd_ret
    from (select *, lag(close, 1) over w / lag(close, 12) over w - 1 as mom, case when count(ret) over v >= 6 then -stddev_samp(ret) over v end as low_vol
      from ret_m window w as (partition by asset order by i), v as (partition by asset order by i rows between 11 preceding and current row)) a
    join sector_of s using (asset)
    left join dense_m f on f.asset = a.asset and f.i = least(a.i + 1, (select max(i) from dense_m))""",
)


@query("s01_read_panel", "select l_suppkey as asset, cast(l_shipdate as date) as date, l_quantity as qty from lineitem")
def _(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.select(F.col("l_suppkey").alias("asset"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("qty"))


@query("p01_ffill_limit", sql("select asset, date, round(close, 8) as close from fill_d", "fill_d"))
def _(spark, sf):
    return rounded(P.ffill_limit(fx.dense_d(spark, sf), 5), "asset", "date", close="close")


@query("p02_ffill_bfill", sql("select asset, date, round(last_value(close ignore nulls) over (partition by asset order by i rows unbounded preceding), 8) as filled, round(first_value(close ignore nulls) over (partition by asset order by i rows between current row and unbounded following), 8) as back from dense_m", "dense_m"))
def _(spark, sf):
    both = P.bfill(P.ffill_limit(fx.dense_m(spark, sf).withColumn("filled", F.col("close")), None, "filled").withColumn("back", F.col("close")), "back")
    return rounded(both, "asset", "date", filled="filled", back="back")


@query("p03_min_obs_filter", sql("select asset, date from px_m where asset in (select asset from px_m group by 1 having count(close) >= 83)", "px_m"))
def _(spark, sf):
    return P.min_obs_filter(fx.px_m(spark, sf), 83).select("asset", "date")


@query(
    "p04_missing_frac_filter",
    sql(
        """select asset, date from own where date in (select date from days, need where n_full = 0 or have >= need)""",
        "px_m",
        tot="select count(distinct date) as total from px_m",
        kept="select asset, count(*) as n from px_m, tot where close is not null group by asset, total having 1 - count(*) / total <= 0.02",
        whole="select asset from kept, tot where n = total",
        need="select greatest(1, cast(floor(0.5 * count(*)) as bigint)) as need, count(*) as n_full from whole",
        own="select px_m.* from px_m where asset in (select asset from kept)",
        days="select date, count(w.asset) as have from own left join whole w on own.asset = w.asset group by date",
    ),
)
def _(spark, sf):
    return P.missing_frac_filter(fx.px_m(spark, sf), 0.02).select("asset", "date")


@query("p05_clip", sql("select asset, date, round(case when ret is not null then least(greatest(ret, -0.15), 0.15) end, 8) as ret from ret_m", "ret_m"))
def _(spark, sf):
    return rounded(ret_m(spark, sf), "asset", "date", ret=clip(F.col("ret"), -0.15, 0.15))


@query("p06_safe_div", "select l_orderkey, l_linenumber, l_partkey, round(case when l_discount - 0.05 <> 0 then l_extendedprice / abs(l_discount - 0.05) end, 4) + 0.0 as q from lineitem")
def _(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    return rounded(lines, "l_orderkey", "l_linenumber", "l_partkey", d=4, q=safe_div(F.col("l_extendedprice"), F.col("l_discount") - 0.05))


@query("p08_segment", sql("select date, count(*) as n, case when date < date '1998-06-01' then 'dev' else 'oos' end as segment from px_m group by date", "px_m"))
def _(spark, sf):
    return P.segment(fx.px_m(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("n")), "1998-06-01")


@query("p09_purchase_filter", sql("select order_id, asset, filed, owner, shares from purchases where upper(code) = 'P' and (flag is null or upper(flag) = 'A')", "purchases"))
def _(spark, sf):
    return P.purchase_filter(fx.purchases(spark, sf)).select("order_id", "asset", "filed", "owner", "shares")


@query("p10_duration_filter", sql("select asset, period_end, filed, form from filings where filed - period_end between 20 and 60", "filings"))
def _(spark, sf):
    return P.duration_filter(fx.filings(spark, sf), 20, 60, "period_end", "filed").select("asset", "period_end", "filed", "form")


@query("p11_finite_fill", sql("select asset, date, round(coalesce(last_value(x ignore nulls) over (partition by asset order by i rows unbounded preceding), 0), 8) as x from (select asset, date, i, case when volume % 7 = 0 then null else close end as x from dense_m)", "dense_m"))
def _(spark, sf):
    x = F.when(F.col("volume") % 7 == 0, F.lit(float("-inf"))).otherwise(F.when(F.col("volume").isNotNull(), F.col("close")))
    return rounded(P.finite_fill(fx.dense_m(spark, sf).withColumn("x", x), "x"), "asset", "date", x="x")


@query("p12_zero_features", sql("select asset, date, 0.0::double as close, volume from px_m", "px_m"))
def _(spark, sf):
    return P.zero_features(fx.px_m(spark, sf), {"price": ["close", "absent"], "size": ["volume"]}, ["price"])


@query("p13_zscore_global", sql("select asset, date, round((close - (select avg(close) from px_m)) / ((select stddev_samp(close) from px_m) + 1e-8), 6) + 0.0 as z from px_m", "px_m"))
def _(spark, sf):
    return rounded(P.zscore_global(fx.px_m(spark, sf), "close"), "asset", "date", d=6, z="close")


@query("p14_rebalance_calendar", sql("select date, i from cal_m where i >= 12 and (i - 12) % 3 = 0", "cal_m"))
def _(spark, sf):
    return C.rebalance_calendar(fx.px_m(spark, sf), 12, 3).select("date", F.col("i").cast("long").alias("i"))


@query("p15_min_names", sql("select asset, date from (select *, count(*) over (partition by date) as n from px_d) where n >= 15", "px_d"))
def _(spark, sf):
    return P.min_names(fx.px_d(spark, sf), 15).select("asset", "date")


@query("p16_date_range", sql("select asset, date, round(close, 8) as close from px_m where date between date '1997-01-01' and date '1998-01-01'", "px_m"))
def _(spark, sf):
    return rounded(P.date_range(fx.px_m(spark, sf), "1997-01-01", "1998-01-01"), "asset", "date", close="close")


@query("j14_forward_price", sql("select a.asset, a.date, round(b.close, 8) as fwd_close from dense_m a left join dense_m b on b.asset = a.asset and b.i = least(a.i + 3, (select max(i) from dense_m))", "dense_m"))
def _(spark, sf):
    return rounded(C.forward_price(fx.dense_m(spark, sf), 3), "asset", "date", fwd_close="fwd_close")


@query("j03_next_trading_day", sql("select order_id, asset, filed, (select min(date) from (select distinct date from px_d) c where c.date > filed) as next_date from purchases where code = 'P'", "purchases", "px_d"))
def _(spark, sf):
    dates = fx.px_d(spark, sf).select("date").distinct()
    return C.next_trading_day(fx.purchases(spark, sf).where("code = 'P'"), dates, "filed").select("order_id", "asset", "filed", "next_date")


#: Features by name: Spark column over ret_m or ret_d, and the same as DuckDB expression over asset's rows.
def put_feature(name: str, columns: dict, expressions: dict[str, str], base: str = "ret_m", d: int = D) -> None:
    frame, spark_base = {"ret_m": ("ret_m", ret_m), "rd": ("rd", ret_d)}[base]
    exprs = ", ".join(f"round({e}, {d}) + 0.0 as {k}" for k, e in expressions.items())

    @query(name, sql(f"select asset, date, {exprs} from {frame} window w as (partition by asset order by i)", frame))
    def _(spark, sf):
        return rounded(spark_base(spark, sf), "asset", "date", d=d, **{k: v() for k, v in columns.items()})


def rows(low: int, high: int) -> str:
    bound = lambda k: "current row" if k == 0 else f"{-k} preceding" if k < 0 else f"{k} following"
    return f"over (partition by asset order by i rows between {bound(low)} and {bound(high)})"


def counted(agg: str, c: str, low: int, high: int, least: int | None = None) -> str:
    o = rows(low, high)
    return f"(case when count({c}) {o} >= {high - low + 1 if least is None else least} then {agg}({c}) {o} end)"


r = lambda: F.col("ret")
put_feature("w01_returns", {"log_ret": lambda: W.log_return(), "ret": lambda: W.simple_return()}, {"log_ret": "ln(close / lag(close) over w)", "ret": "close / lag(close) over w - 1"})
put_feature("w06_rolling", {"s": lambda: W.rolling(r(), -5, 0, F.sum), "m": lambda: W.rolling(r(), -5, 0, F.avg, 3), "sd": lambda: W.rolling(r(), -5, 0, F.stddev_samp)}, {"s": counted("sum", "ret", -5, 0), "m": counted("avg", "ret", -5, 0, 3), "sd": counted("stddev_samp", "ret", -5, 0)})
put_feature("w07_lag_lead", {"before": lambda: W.lag("close", 12), "after": lambda: W.lag("close", -1)}, {"before": "lag(close, 12) over w", "after": "lead(close, 1) over w"})
put_feature("w08_momentum_12_1", {"mom": lambda: W.momentum(1, 12)}, {"mom": "lag(close, 1) over w / lag(close, 12) over w - 1"})
put_feature("w09_momentum_sum", {"a": lambda: W.sum_momentum(r(), 12, 1), "b": lambda: W.sum_momentum(r(), 12, 2, 9)}, {"a": counted("sum", "ret", -12, -2), "b": counted("sum", "ret", -12, -3, 9)})
put_feature("w10_realized_vol", {"vol": lambda: W.realized_vol(r(), 12, 12)}, {"vol": f"sqrt(12) * {counted('stddev_samp', 'ret', -11, 0, 2)}"})
put_feature("w11_past_vol", {"vol": lambda: W.past_vol(r(), 60, 252, 0.06)}, {"vol": f"(case when count(ret) {rows(-60, -1)} >= 2 then greatest(sqrt(252) * stddev_samp(ret) {rows(-60, -1)}, 0.06) end)"}, "rd")
put_feature("w12_downside_vol", {"vol": lambda: W.downside_vol(r(), 21, 252)}, {"vol": f"(case when count(ret) {rows(-20, 0)} >= 21 then sqrt(504) * stddev_samp(case when ret is not null then least(ret, 0) end) {rows(-20, 0)} end)"}, "rd")
put_feature("w13_trend_signal", {"signal": lambda: W.trend_signal([3, 6, 12])}, {"signal": "(" + " + ".join(f"coalesce(sign(close / lag(close, {k}) over w - 1), 0)" for k in (3, 6, 12)) + ") / 3.0"})
put_feature("w14_rolling_ols", {k: (lambda k=k: W.rolling_ols("ret", "volume", 24, 12)[k]) for k in ("alpha", "beta", "resid")}, {
    k: f"(case when count(case when ret is not null then volume end) {rows(-24, -1)} >= 12 and var_samp(case when ret is not null then volume end) {rows(-24, -1)} > 1e-12 then {v} end)"
    for k, v in {"alpha": f"regr_intercept(ret, volume) {rows(-24, -1)}", "beta": f"regr_slope(ret, volume) {rows(-24, -1)}", "resid": f"ret - regr_intercept(ret, volume) {rows(-24, -1)} - regr_slope(ret, volume) {rows(-24, -1)} * volume"}.items()
}, d=7)
put_feature("w15_forward_sum", {"fwd": lambda: W.forward_sum(r(), 3)}, {"fwd": counted("sum", "ret", 1, 3)})
put_feature("w18_rolling_corr", {"corr": lambda: W.rolling_corr("ret", "volume", 12)}, {"corr": f"(case when count(case when volume is not null then ret end) {rows(-11, 0)} >= 12 then corr(ret, volume) {rows(-11, 0)} end)"}, d=7)
put_feature("w19_relative_volume", {"rel": lambda: W.relative_volume("volume", 3, 12)}, {"rel": f"(case when count(volume) {rows(-2, 0)} >= 3 then avg(greatest(volume, 1)) {rows(-2, 0)} end) / ((case when count(volume) {rows(-11, 0)} >= 12 then avg(greatest(volume, 1)) {rows(-11, 0)} end) + 1e-6)"})
put_feature("w20_high_ratio", {"ratio": lambda: W.high_ratio("close", 12, 6)}, {"ratio": f"close / {counted('max', 'close', -11, 0, 6)}"})
put_feature("w30_adv_dollar", {"adv": lambda: W.adv_dollar(6, 3)}, {"adv": counted("avg", "close * volume", -5, 0, 3)}, d=4)
put_feature("w31_expanding_std", {"sd": lambda: W.expanding_std(r(), 12, ("asset",), "i")}, {"sd": "(case when count(ret) over (partition by asset order by i rows between unbounded preceding and 1 preceding) >= 12 then stddev_samp(ret) over (partition by asset order by i rows between unbounded preceding and 1 preceding) end)"})


@query("w03_drawdown", sql("select asset, date, round(eq, 8) as equity, round(eq / max(eq) over (partition by asset order by date rows unbounded preceding) - 1, 8) + 0.0 as drawdown from (select asset, date, exp(sum(ln(1 + coalesce(case when ret is not null then least(greatest(ret, -0.15), 0.15) end, 0))) over (partition by asset order by date rows unbounded preceding)) as eq from ret_m)", "ret_m"))
def _(spark, sf):
    df = W.drawdown(ret_m(spark, sf).withColumn("ret", clip(F.col("ret"), -0.15, 0.15)), "ret", ("asset",))
    return rounded(df, "asset", "date", equity="equity", drawdown="drawdown")


@query("w04_forward_return", sql("select date, asset, round(fwd_ret, 8) + 0.0 as fwd_ret from scores", "scores"))
def _(spark, sf):
    return rounded(scores(spark, sf), "date", "asset", fwd_ret="fwd_ret")


@query("w05_hold_returns", sql("select asset, hold, round(product(1 + coalesce(ret, 0)) - 1, 8) + 0.0 as hold_ret from (select asset, cast(floor((i - 1) / 21) as bigint) as hold, ret from rd where i >= 1) group by asset, hold", "rd"))
def _(spark, sf):
    return rounded(W.hold_returns(ret_d(spark, sf), "ret", 21), "asset", "hold", hold_ret="hold_ret")


@query("w16_forward_cs_excess", sql(f"select asset, date, round(f - avg(f) over (partition by date), 8) + 0.0 as excess from (select asset, date, {counted('sum', 'ret', 1, 3)} as f from ret_m)", "ret_m"))
def _(spark, sf):
    df = ret_m(spark, sf).withColumn("f", W.forward_sum(F.col("ret"), 3))
    return rounded(df, "asset", "date", excess=X.demean("f"))


@query("w17_pctile_rank", sql("""select a.asset, a.date, round(case when a.ret is not null and count(b.ret) >= 12 then (count(*) filter (b.ret < a.ret) + (count(*) filter (b.ret = a.ret) + 1) / 2.0) / count(b.ret) end, 8) as rank
    from ret_m a join ret_m b on b.asset = a.asset and b.i between a.i - 23 and a.i group by a.asset, a.date, a.ret""", "ret_m"))
def _(spark, sf):
    return rounded(ret_m(spark, sf), "asset", "date", rank=W.pctile_rank("ret", 24, 12))


@query("w22_age_days", sql("select asset, date, case when date - first > 0 then cast(date - first as int) end as age from (select *, min(case when close is not null then date end) over (partition by asset) as first from dense_m)", "dense_m"))
def _(spark, sf):
    return fx.dense_m(spark, sf).select("asset", "date", W.age_days().alias("age"))


@query("w32_multi_horizon", sql("select asset, date, " + ", ".join(f"round(case when count(ret) {rows(0, k - 1)} = {k} then exp(sum(ln(1 + ret)) {rows(0, k - 1)}) - 1 end, 8) + 0.0 as h{k}" for k in (1, 3, 6)) + " from ret_m", "ret_m"))
def _(spark, sf):
    df = ret_m(spark, sf).withColumn("h", W.multi_horizon("ret", 6))
    return rounded(df, "asset", "date", **{f"h{k}": F.col("h")[k - 1] for k in (1, 3, 6)})


@query("w36_next_target", sql("select asset, date, round(t, 8) + 0.0 as target from (select asset, date, lead(ret) over (partition by asset order by i) as t from ret_m) where t is not null", "ret_m"))
def _(spark, sf):
    return rounded(ret_m(spark, sf).withColumn("t", W.lag("ret", -1)).where("t is not null"), "asset", "date", target="t")


#: DuckDB: cross-sectional expressions.
def q_winsor(c: str) -> str:
    return f"case when {c} is null or count({c}) over (partition by date) < 5 then {c} else greatest(least({c}, quantile_cont({c}, 0.98) over (partition by date)), quantile_cont({c}, 0.02) over (partition by date)) end"


def q_z(c: str) -> str:
    s = f"stddev_samp({c}) over (partition by date)"
    return f"case when {s} is null or {s} < 1e-12 or count({c}) over (partition by date) < 5 then 0 else ({c} - avg({c}) over (partition by date)) / {s} end"


def q_rank(c: str, by: str = "date") -> str:
    return f"case when {c} is not null then rank() over (partition by {by}, {c} is null order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0 end"


@query("x01_winsorize", sql(f"select date, asset, round({q_winsor('mom')}, 8) + 0.0 as w from scores", "scores"))
def _(spark, sf):
    return rounded(scores(spark, sf), "date", "asset", w=X.winsorize("mom"))


@query("x02_zscore", sql(f"select date, asset, round({q_z('mom')}, 8) + 0.0 as z from scores", "scores"))
def _(spark, sf):
    return rounded(scores(spark, sf), "date", "asset", z=X.zscore("mom"))


CTE["neutral"] = ("scores", f"select *, {q_z('dm')} as z from (select *, mom - avg(mom) over (partition by date, sector) as dm from scores)")


@query("x03_group_neutralize", sql("select date, asset, round(z, 8) + 0.0 as z from neutral", "neutral"))
def _(spark, sf):
    return rounded(X.neutral(scores(spark, sf), "mom", "z"), "date", "asset", z="z")


@query("x04_row_mean", sql("select date, asset, round((coalesce(mom, 0) + coalesce(low_vol, 0) + coalesce(size, 0)) / nullif((mom is not null)::int + (low_vol is not null)::int + (size is not null)::int, 0), 8) + 0.0 as m from scores", "scores"))
def _(spark, sf):
    return rounded(scores(spark, sf), "date", "asset", m=row_mean("mom", "low_vol", "size"))


for key, col in (("x07_momentum_factor", "mom"), ("x08_low_vol_factor", "low_vol"), ("x09_size_factor", "size")):

    @query(key, sql(f"select date, asset, round({q_z('w')}, 8) + 0.0 as z from (select date, asset, {q_winsor(col)} as w from scores)", "scores"))
    def _(spark, sf, col=col):
        return rounded(scores(spark, sf).withColumn("w", X.winsorize(col)), "date", "asset", z=X.zscore("w"))


FACTORS = ("mom", "low_vol", "size")
CTE["factor_scores"] = (
    "scores",
    f"select date, i, asset, sector, fwd_ret, {', '.join(f'{q_z(f"{c}_n")} as {c}_z' for c in FACTORS)} from (select *, {', '.join(f'{c}_w - avg({c}_w) over (partition by date, sector) as {c}_n' for c in FACTORS)} from (select *, {', '.join(f'{q_winsor(c)} as {c}_w' for c in FACTORS)} from scores))",
)
CTE["composite"] = ("factor_scores", "select *, (coalesce(mom_z, 0) + coalesce(low_vol_z, 0)) / nullif((mom_z is not null)::int + (low_vol_z is not null)::int, 0) as composite from factor_scores")


def factor_panel(spark, sf):
    """Written, as books, ledgers and models have many branches over it."""
    return written(X.factor_scores(scores(spark, sf), [*FACTORS], ["mom", "low_vol"]))


@query("x11_pct_rank", sql(f"select date, asset, round(({q_rank('mom')}) / count(mom) over (partition by date), 8) as rank from scores", "scores"))
def _(spark, sf):
    return rounded(scores(spark, sf), "date", "asset", rank=X.pct_rank("mom"))


@query("x12_demean_target", sql(f"select date, asset, round({q_winsor('t')}, 8) + 0.0 as target, round(coalesce(mom, 0), 8) + 0.0 as mom from (select *, fwd_ret - avg(fwd_ret) over (partition by date) as t from scores)", "scores"))
def _(spark, sf):
    df = scores(spark, sf).withColumn("t", X.demean("fwd_ret"))
    return rounded(df, "date", "asset", target=X.winsorize("t"), mom=F.coalesce("mom", F.lit(0.0)))


def q_composite(weights: dict[str, float]) -> str:
    ok = {c: f"(count({c}) over (partition by date) >= 3 and stddev_samp({c}) over (partition by date) >= 1e-8)" for c in weights}
    total = " + ".join(f"coalesce(case when {ok[c]} then {w} * ({c} - avg({c}) over (partition by date)) / stddev_samp({c}) over (partition by date) end, 0)" for c, w in weights.items())
    used = " + ".join(f"(case when {ok[c]} then {abs(w)} else 0 end)" for c, w in weights.items())
    return f"({total}) / nullif({used}, 0)"


for key, weights in (("x13_weighted_composite", {"mom": 0.35, "low_vol": 0.35, "size": -0.30}), ("x14_momentum_rank_model", {"mom": 0.65, "low_vol": 0.35})):

    @query(key, sql(f"select date, asset, round({q_composite(weights)}, 8) + 0.0 as score from scores", "scores"))
    def _(spark, sf, weights=weights):
        return rounded(X.composite(scores(spark, sf), weights, "score"), "date", "asset", score="score")


@query("x17_softmax_topn", sql("select date, asset, round(f / sum(f) over (partition by date), 8) as weight from (select *, greatest(e / sum(e) over (partition by date), 0.1) as f from (select *, exp(mom - max(mom) over (partition by date)) as e from (select *, rank() over (partition by date order by mom desc) as r from scores where mom is not null) where r <= 3))", "scores"))
def _(spark, sf):
    return rounded(X.softmax_topn(scores(spark, sf), "mom", 3, 0.1), "date", "asset", weight="weight")


CTE["ics"] = ("composite", f"select date, count(*) as n, case when count(*) >= 10 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end as ic from (select date, {q_rank('composite')} as a, {q_rank('fwd_ret')} as b from composite where composite is not null and fwd_ret is not null) group by date")


def ics(spark, sf):
    return X.rank_ic(factor_panel(spark, sf), "composite", "fwd_ret")


@query("x18_rank_ic", sql("select date, n, round(ic, 6) + 0.0 as ic from ics", "ics"))
def _(spark, sf):
    return rounded(ics(spark, sf), "date", "n", d=6, ic="ic")


@query("a10_ic_summary", sql("select round(avg(ic), 6) as mean_ic, round(avg(ic) / stddev_samp(ic), 6) as ir, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 6) as t, round(avg((ic > 0)::int), 6) as hit, count(*) as n from ics where ic is not null", "ics"))
def _(spark, sf):
    return L.ic_summary(ics(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("mean_ic", "ir", "t", "hit")], "n")


CTE["placed"] = ("composite", "select *, row_number() over (partition by date order by composite desc, asset) as top, row_number() over (partition by date order by composite, asset desc) as bottom, count(*) over (partition by date) as n, greatest(1, cast(floor(count(*) over (partition by date) * 0.2 + 1e-9) as int)) as k from composite where composite is not null")
CTE["book"] = ("placed", "select date, asset, case when top <= k then 1.0 / k else -1.0 / k end as w from placed where n >= 10 and (top <= k or bottom <= k)")


def book(spark, sf):
    return written(K.long_short(factor_panel(spark, sf), "composite"))


@query("k01_long_short_quantile", sql("select date, asset, round(w, 8) as w from book", "book"))
def _(spark, sf):
    return rounded(book(spark, sf), "date", "asset", w="w")


@query("k02_long_only_quantile", sql("select date, asset, round(w, 8) as w from book where w > 0", "book"))
def _(spark, sf):
    return rounded(K.long_only(factor_panel(spark, sf), "composite"), "date", "asset", w="w")


@query("k03_half_gross_quantile", sql("select date, asset, round(w / 2, 8) as w from book", "book"))
def _(spark, sf):
    return rounded(K.long_short(factor_panel(spark, sf), "composite", leg_gross=0.5), "date", "asset", w="w")


@query("k04_top_bottom_n", sql("select date, string_agg(cast(asset as varchar), '|' order by top) filter (top <= 3) as longs, string_agg(cast(asset as varchar), '|' order by bottom) filter (bottom <= 3) as shorts from placed where n >= 6 group by date", "placed"))
def _(spark, sf):
    return K.top_bottom(factor_panel(spark, sf), "composite", 3)


@query("k13_decile_spread", sql("select date, round(avg(fwd_ret) filter (top <= k) - avg(fwd_ret) filter (bottom <= k), 8) + 0.0 as spread from (select *, row_number() over (partition by date order by composite desc, asset) as top, row_number() over (partition by date order by composite, asset desc) as bottom, greatest(1, cast(floor(count(*) over (partition by date) * 0.1 + 1e-9) as int)) as k from composite where composite is not null and fwd_ret is not null) group by date", "composite"))
def _(spark, sf):
    return rounded(K.decile_spread(factor_panel(spark, sf), "composite", "fwd_ret", 0.1), "date", spread="spread")


CTE["turnover"] = ("book", """select date, sum(abs(coalesce(a, 0) - coalesce(b, 0))) as turnover from (
    select coalesce(x.k, y.k) as k, x.w as a, y.w as b from nb x full join (select k + 1 as k, asset, w from nb) y on x.k = y.k and x.asset = y.asset) t join bk using (k) group by date""")
CTE["bk"] = ("book", "select date, row_number() over (order by date) as k from (select distinct date from book)")
CTE["nb"] = ("book bk", "select book.*, k from book join bk using (date)")
CTE["turnover"] = ("nb", CTE["turnover"][1])


@query("a13_turnover", sql("select date, round(turnover, 8) as turnover from turnover", "turnover"))
def _(spark, sf):
    return rounded(L.turnover(book(spark, sf)), "date", turnover="turnover")


@query("j08_weights_full_outer", sql("select date, asset, round(coalesce(a, 0), 8) as w, round(coalesce(b, 0), 8) as w_before from (select coalesce(x.k, y.k) as k, coalesce(x.asset, y.asset) as asset, x.w as a, y.w as b from nb x full join (select k + 1 as k, asset, w from nb) y on x.k = y.k and x.asset = y.asset) join bk using (k)", "nb"))
def _(spark, sf):
    from pyspark.sql import Window

    w = book(spark, sf)
    dates = w.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    numbered = w.join(dates, "date").drop("date")
    before = numbered.select((F.col("k") + 1).alias("k"), "asset", F.col("w").alias("b"))
    both = numbered.join(before, ["k", "asset"], "full").join(dates, "k")
    return rounded(both, "date", "asset", w=F.coalesce("w", F.lit(0.0)), w_before=F.coalesce("b", F.lit(0.0)))


CTE["bret"] = ("book scores", "select date, sum(c) as ret, coalesce(sum(c) filter (w > 0), 0) as long_ret, coalesce(sum(c) filter (w < 0), 0) as short_ret, count(*) filter (w > 0) as n_long, count(*) filter (w < 0) as n_short, sum(abs(w)) as gross, coalesce(sum(-w) filter (w < 0), 0) as short_gross from (select book.date, w, w * coalesce(fwd_ret, 0) as c from book left join scores using (date, asset)) group by date")


@query("a14_book_return", sql("select date, n_long, n_short, round(ret, 8) + 0.0 as ret, round(long_ret, 8) + 0.0 as long_ret, round(short_ret, 8) + 0.0 as short_ret, round(gross, 8) as gross from bret", "bret"))
def _(spark, sf):
    panel = factor_panel(spark, sf)
    return rounded(L.book_return(written(K.long_short(panel, "composite")), panel), "date", "n_long", "n_short", ret="ret", long_ret="long_ret", short_ret="short_ret", gross="gross")


CTE["held"] = ("scores", "select date, max(21 * (least(i + 1, (select max(i) from scores)) - i)) as held from scores group by date")
CTE["ledger"] = ("bret turnover held", "select *, ret - 0.01 * held / 252.0 * short_gross as period_return, 0.01 * held / 252.0 * short_gross as borrow_cost from bret join turnover using (date) join held using (date)")
CTE["path"] = ("ledger", "select *, 1e6 * exp(sum(ln(1 - turnover * 0.001) + ln(1 + period_return)) over (order by date rows unbounded preceding)) as capital from ledger")


def ledger(spark, sf):
    panel = factor_panel(spark, sf)
    return ledger_of(panel, written(K.long_short(panel, "composite")))


def ledger_of(panel, weights):
    last = panel.agg(F.max("i").alias("end"))
    # One row: the calendar's end.
    fwd = panel.join(F.broadcast(last)).select("date", "asset", "fwd_ret", "i", "end")
    return L.portfolio_ledger(weights, fwd, 21 * (F.least(F.col("i") + 1, F.col("end")) - F.col("i")), 0.001, 0.01)


@query("b01_portfolio_ledger", sql("select date, round(turnover, 8) as turnover, round(period_return, 8) + 0.0 as period_return, round(capital, 3) as capital from path", "path"))
def momentum_book(spark, sf):
    df = ledger(spark, sf)
    return df.select("date", F.round("turnover", 8).alias("turnover"), (F.round("period_return", 8) + 0.0).alias("period_return"), F.round("capital", 3).alias("capital"))


@query("b02_borrow_cost", sql("select date, round(borrow_cost, 10) + 0.0 as borrow_cost from ledger", "ledger"))
def _(spark, sf):
    return rounded(ledger(spark, sf), "date", d=10, borrow_cost="borrow_cost")


@query("b03_benchmark_return", sql("select date, round(avg(fwd_ret), 8) + 0.0 as benchmark_return from scores group by date", "scores"))
def _(spark, sf):
    return rounded(scores(spark, sf).groupBy("date").agg(F.avg("fwd_ret").alias("b")), "date", benchmark_return="b")


@query("a09_perf_stats", sql("""select 'book' as strategy, round(product(1 + period_return) - 1, 6) as total, round(avg(period_return) / stddev_samp(period_return) * sqrt(12), 6) as sharpe, round(stddev_samp(period_return) * sqrt(12), 6) as vol, round(min(dd), 6) as max_dd, count(*) as n
    from (select *, eq / max(eq) over (order by date rows unbounded preceding) - 1 as dd from (select *, exp(sum(ln(1 + period_return)) over (order by date rows unbounded preceding)) as eq from ledger))""", "ledger"))
def _(spark, sf):
    df = L.perf_stats(ledger(spark, sf).withColumn("strategy", F.lit("book")), 12, ("strategy",), "period_return")
    return df.select("strategy", *[F.round(c, 6).alias(c) for c in ("total", "sharpe", "vol", "max_dd")], "n")


@query("b10_cost_grid", sql("select bps, round(avg(r) * 12, 8) as mean_ret, round(avg(r) / stddev_samp(r) * sqrt(12), 6) as sharpe from (select bps, ret - turnover * bps / 1e4 as r from ledger, (select unnest([0.0::double, 5, 10, 15, 20, 30, 50]) as bps)) group by bps", "ledger"))
def _(spark, sf):
    df = L.cost_grid(ledger(spark, sf), [0.0, 5.0, 10.0, 15.0, 20.0, 30.0, 50.0], 12)
    return df.select("bps", F.round("mean_ret", 8).alias("mean_ret"), F.round("sharpe", 6).alias("sharpe"))
