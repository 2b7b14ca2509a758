"""Queries: sleeves of returns, risk, econometrics, pairs."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.columns import clip, correlation, nearest
from panelspark.operators import blocks as BL
from panelspark.operators import clean as P
from panelspark.operators import construct as K
from panelspark.operators import ledger as L
from panelspark.operators import risk as R
from panelspark.operators import stats as E
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.operators.calendar import calendar
from panelspark.plans import fixtures as fx
from panelspark.plans.core import book, factor_panel, ledger, ledger_of, ret_d, ret_m, rounded, scores
from panelspark.plans.fixtures import CTE, sql
from panelspark.plans.registry import query
from panelspark.sources.shared import written

SPLIT = "1999-06-01"
CTE["sleeves"] = ("ret_m sector_of", "select sector as strategy, date, avg(least(greatest(ret, -0.15), 0.15)) as ret from ret_m join sector_of using (asset) where ret is not null group by 1, 2")
CTE["seg"] = ("sleeves", f"select *, case when date < date '{SPLIT}' then 'dev' else 'oos' end as segment from sleeves")


def sleeves(spark, sf):
    df = ret_m(spark, sf).where("ret is not null").join(fx.sector_of(spark, sf), "asset")
    return df.groupBy(F.col("sector").alias("strategy"), "date").agg(F.avg(clip(F.col("ret"), -0.15, 0.15)).alias("ret"))


def agg_query(name: str, exprs: dict, oracle: dict[str, str], d: int = 6) -> None:
    @query(name, sql("select strategy, " + ", ".join(f"round({v}, {d}) + 0.0 as {k}" for k, v in oracle.items()) + " from sleeves group by strategy", "sleeves"))
    def _(spark, sf):
        return rounded(sleeves(spark, sf).groupBy("strategy").agg(*[v().alias(k) for k, v in exprs.items()]), "strategy", d=d, **{k: k for k in exprs})


Z = {c: NormalDist().inv_cdf(1 - c) for c in (0.95, 0.99)}
CTE["cent"] = ("sleeves", "select strategy, ret, avg(ret) over (partition by strategy) as mu, stddev_pop(ret) over (partition by strategy) as sd from sleeves")
agg_query("r01_var_historical", {"v95": lambda: R.var_historical("ret", 0.95), "v99": lambda: R.var_historical("ret", 0.99)}, {"v95": "-quantile_cont(ret, 0.05)", "v99": "-quantile_cont(ret, 0.01)"})
agg_query("r02_var_parametric", {"v95": lambda: R.var_parametric("ret", 0.95)}, {"v95": f"-(avg(ret) + {Z[0.95]!r} * stddev_pop(ret))"})


@query("r03_var_cornish_fisher", sql(f"select strategy, round(-(mu + ({Z[0.95]!r} + {(Z[0.95] ** 2 - 1) / 6!r} * s + {(Z[0.95] ** 3 - 3 * Z[0.95]) / 24!r} * k - {(2 * Z[0.95] ** 3 - 5 * Z[0.95]) / 36!r} * s * s) * sd), 6) + 0.0 as v95 from (select strategy, mu, sd, avg(pow((ret - mu) / sd, 3)) as s, avg(pow((ret - mu) / sd, 4)) - 3 as k from cent group by strategy, mu, sd)", "cent"))
def _(spark, sf):
    return rounded(sleeves(spark, sf).groupBy("strategy").agg(R.var_cornish_fisher("ret", 0.95).alias("v")), "strategy", d=6, v95="v")


@query("r04_cvar", sql("select strategy, round(-avg(ret), 6) + 0.0 as cvar from (select *, quantile_cont(ret, 0.05) over (partition by strategy) as q from sleeves) where ret <= q group by strategy", "sleeves"))
def _(spark, sf):
    return rounded(R.cvar(sleeves(spark, sf), "ret", ["strategy"], 0.95), "strategy", d=6, cvar="cvar")


CTE["curves"] = ("sleeves", "select *, eq / max(eq) over (partition by strategy order by date rows unbounded preceding) - 1 as dd from (select *, exp(sum(ln(1 + ret)) over (partition by strategy order by date rows unbounded preceding)) as eq from sleeves)")


@query("r06_max_drawdown", sql("select strategy, round(min(dd), 6) + 0.0 as max_dd from curves group by strategy", "curves"))
def _(spark, sf):
    return rounded(W.drawdown(sleeves(spark, sf), "ret", ("strategy",)).groupBy("strategy").agg(F.min("drawdown").alias("d")), "strategy", d=6, max_dd="d")


CTE["bench"] = ("sleeves", "select date, avg(ret) as bench from sleeves group by date")


@query("r07_beta", sql("select strategy, round(covar_samp(ret, bench) / (var_pop(bench) + 1e-8), 6) as beta from sleeves join bench using (date) group by strategy", "bench"))
def _(spark, sf):
    s = sleeves(spark, sf)
    both = s.join(s.groupBy("date").agg(F.avg("ret").alias("bench")), "date")
    return rounded(both.groupBy("strategy").agg(R.beta("ret", "bench").alias("b")), "strategy", d=6, beta="b")


#: DuckDB: rows of all sleeves with benchmark, drawdown and the quantiles of each sleeve.
CTE["risk_rows"] = (
    "curves bench",
    "select c.*, bench, avg(ret) over w as mu, stddev_pop(ret) over w as sd, quantile_cont(ret, 0.05) over w as q95, quantile_cont(ret, 0.01) over w as q99 from curves c join bench using (date) window w as (partition by strategy)",
)
RATIOS = {
    "sharpe": "avg(ret) / (stddev_pop(ret) + 1e-8) * sqrt(12)",
    "sortino": "avg(ret) / sqrt(coalesce(avg(case when ret < -1e-12 then ret * ret end), 0) + 1e-8) * sqrt(12)",
    "omega": "sum(greatest(ret, 0)) / (sum(greatest(-ret, 0)) + 1e-8)",
    "calmar": "avg(ret) * 12 / (abs(min(dd)) + 1e-8)",
    "information_ratio": "avg(ret - bench) / (stddev_pop(ret - bench) + 1e-8) * sqrt(12)",
}
SKEW, KURT = "avg(pow((ret - mu) / sd, 3))", "(avg(pow((ret - mu) / sd, 4)) - 3)"


def q_fisher(c: float) -> str:
    z = Z[c]
    return f"-(avg(ret) + ({z!r} + {(z**2 - 1) / 6!r} * {SKEW} + {(z**3 - 3 * z) / 24!r} * {KURT} - {(2 * z**3 - 5 * z) / 36!r} * {SKEW} * {SKEW}) * stddev_pop(ret))"


REPORT = {
    "annualized_return": "avg(ret) * 12",
    "annualized_vol": "stddev_pop(ret) * sqrt(12)",
    "max_drawdown": "min(dd)",
    "skewness": SKEW,
    "kurtosis": KURT,
    "beta": "covar_samp(ret, bench) / (var_pop(bench) + 1e-8)",
    **RATIOS,
    **{
        f"{m}_{round(100 * c)}": e
        for c in (0.95, 0.99)
        for m, e in {
            "var_hist": f"-quantile_cont(ret, {1 - c:.2f})",
            "var_param": f"-(avg(ret) + {Z[c]!r} * stddev_pop(ret))",
            "var_cf": q_fisher(c),
            "cvar": f"-avg(ret) filter (ret <= q{round(100 * c)})",
        }.items()
    },
}


def with_bench(df):
    return df.join(df.groupBy("date").agg(F.avg("ret").alias("bench")), "date")


@query("r05_ratios", sql("select strategy, " + ", ".join(f"round({e}, 6) + 0.0 as {k}" for k, e in RATIOS.items()) + " from risk_rows group by strategy", "risk_rows"))
def _(spark, sf):
    rows = W.drawdown(with_bench(sleeves(spark, sf)), "ret", ("strategy",))
    found = R.ratios("ret", 12, "bench", "drawdown")
    return rounded(rows.groupBy("strategy").agg(*[v.alias(k) for k, v in found.items()]), "strategy", d=6, **{k: k for k in found})


@query(
    "r08_risk_report",
    sql(
        "select strategy, metric, round(value, 6) + 0.0 as value from (select strategy, unnest([" + ", ".join(f"'{k}'" for k in REPORT) + "]) as metric, unnest([" + ", ".join(REPORT.values()) + "]) as value from risk_rows group by strategy)",
        "risk_rows",
    ),
)
def _(spark, sf):
    df = R.risk_report(with_bench(sleeves(spark, sf)), "ret", "bench", ["strategy"], 12, [0.95, 0.99])
    return rounded(df, "strategy", "metric", d=6, value="value")


CTE["paths"] = ("", "select vec_id as sim, cast(unnest(generate_series(0, len(embedding) - 1)) as int) as step, cast(unnest(embedding) as double) as ret from embeddings")


def paths(spark, sf):
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sim"), F.posexplode("embedding").alias("step", "r")).select("sim", "step", F.col("r").cast("double").alias("ret"))


@query("r09_path_statistics", sql("select round(avg(s), 6) + 0.0 as mean, round(stddev_pop(s), 6) as std, round(median(s), 6) + 0.0 as median, round(quantile_cont(s, 0.01), 6) as p1, round(quantile_cont(s, 0.05), 6) as p5, round(quantile_cont(s, 0.95), 6) as p95, round(avg((s > 0)::int), 6) as p_up, round(-avg(s) filter (s <= (select quantile_cont(s, 0.05) from sums)), 6) as es95 from sums", "paths", sums="select sim, sum(ret) as s from paths group by sim"))
def _(spark, sf):
    names = ("mean", "std", "median", "p1", "p5", "p95", "p_up", "es95")
    return rounded(R.path_statistics(paths(spark, sf)), d=6, **{n: n for n in names})


@query("r10_confidence_bands", sql("select step, unnest([0.05::double, 0.5, 0.95]) as level, round(unnest([quantile_cont(c, 0.05), quantile_cont(c, 0.5), quantile_cont(c, 0.95)]), 6) + 0.0 as value from (select step, sum(ret) over (partition by sim order by step rows unbounded preceding) as c from paths) group by step", "paths"))
def _(spark, sf):
    return rounded(R.confidence_bands(paths(spark, sf), [0.05, 0.5, 0.95]), "step", "level", d=6, value="value")


@query("r11_scenario_moments", sql("select scenario, strategy, round(avg(ret) * 12 + shift, 6) + 0.0 as mu, round(stddev_samp(ret) * sqrt(12) * scale, 6) as vol from sleeves, (values ('base', 0.0, 1.0), ('bullish', 0.05, 0.8), ('bearish', -0.05, 1.2), ('crisis', -0.2, 2.0)) t(scenario, shift, scale) group by scenario, strategy, shift, scale", "sleeves"))
def _(spark, sf):
    facts = sleeves(spark, sf).groupBy("strategy").agg((F.avg("ret") * 12).alias("mu"), (F.stddev_samp("ret") * 12**0.5).alias("vol"))
    table = F.expr("array(struct('base' as scenario, 0D as shift, 1D as scale), struct('bullish' as scenario, 0.05D as shift, 0.8D as scale), struct('bearish' as scenario, -0.05D as shift, 1.2D as scale), struct('crisis' as scenario, -0.2D as shift, 2D as scale))")
    each = facts.withColumn("s", F.explode(table)).select("s.*", "strategy", "mu", "vol")
    return rounded(each, "scenario", "strategy", d=6, mu=F.col("mu") + F.col("shift"), vol=F.col("vol") * F.col("scale"))


@query("a04_cs_dispersion", sql("select date, round(stddev_samp(ret), 8) as dispersion from ret_m group by date", "ret_m"))
def _(spark, sf):
    return rounded(ret_m(spark, sf).groupBy("date").agg(F.stddev_samp("ret").alias("d")), "date", dispersion="d")


@query("a05_breadth", sql("select date, round(avg(case when s > 0 then 1.0 else 0.0 end), 8) as breadth from (select date, case when count(ret) over w >= 6 then sum(ret) over w end as s from ret_m window w as (partition by asset order by i rows between 5 preceding and current row)) group by date", "ret_m"))
def _(spark, sf):
    df = ret_m(spark, sf).withColumn("s", W.rolling(F.col("ret"), -5, 0, F.sum))
    return rounded(df.groupBy("date").agg(F.avg(F.when(F.col("s") > 0, 1.0).otherwise(0.0)).alias("b")), "date", breadth="b")


@query("a06_coverage_stats", sql("select date, round(avg((close is not null)::int), 8) as coverage, count(distinct asset) as n from dense_m group by date", "dense_m"))
def _(spark, sf):
    df = fx.dense_m(spark, sf).groupBy("date").agg(F.avg(F.col("close").isNotNull().cast("int")).alias("c"), F.countDistinct("asset").alias("n"))
    return rounded(df, "date", "n", coverage="c")


@query("a07_month_end_last", sql("select asset, last_day(date) as month, round(arg_max(close, date), 7) as close from px_d group by 1, 2", "px_d"))
def _(spark, sf):
    df = fx.px_d(spark, sf).groupBy("asset", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("close"))
    return rounded(df, "asset", "month", d=7, close="close")


@query("a11_segment_rollup", sql("select strategy, coalesce(segment, 'FULL') as segment, round(avg(ret) * 12, 6) + 0.0 as mean, count(*) as n from seg group by grouping sets ((strategy, segment), (strategy))", "seg"))
def _(spark, sf):
    df = P.segment(sleeves(spark, sf), SPLIT).groupingSets([["strategy", "segment"], ["strategy"]], "strategy", "segment").agg((F.avg("ret") * 12).alias("mean"), F.count(F.lit(1)).alias("n"))
    return df.select("strategy", F.coalesce("segment", F.lit("FULL")).alias("segment"), (F.round("mean", 6) + 0.0).alias("mean"), "n")


@query("p08_segment_perf", sql("select strategy, segment, round(product(1 + ret) - 1, 6) + 0.0 as total, round(avg(ret) / stddev_samp(ret) * sqrt(12), 6) + 0.0 as sharpe, count(*) as n from seg group by strategy, segment", "seg"))
def _(spark, sf):
    df = L.perf_stats(P.segment(sleeves(spark, sf), SPLIT), 12, ("strategy", "segment"))
    return df.select("strategy", "segment", (F.round("total", 6) + 0.0).alias("total"), (F.round("sharpe", 6) + 0.0).alias("sharpe"), "n")


EXTENDED = {
    "total": "product(1 + ret) - 1",
    "bench_total": "product(1 + bench) - 1",
    "excess": "product(1 + ret) - product(1 + bench)",
    "annual": "pow(product(1 + ret), 12.0 / count(*)) - 1",
    "info_ratio": "avg(ret - bench) / stddev_samp(ret - bench) * sqrt(12)",
    "hit": "avg(case when ret > bench then 1.0 else 0.0 end)",
}


@query("a12_extended_perf", sql("select strategy, " + ", ".join(f"round({e}, 6) + 0.0 as {k}" for k, e in EXTENDED.items()) + " from sleeves join bench using (date) group by strategy having count(*) >= 4", "bench"))
def _(spark, sf):
    return rounded(L.extended_perf(with_bench(sleeves(spark, sf)), "ret", "bench", 12, ("strategy",)), "strategy", d=6, **{k: k for k in EXTENDED})


@query("a15_corr_matrix", sql("select a.strategy as a, b.strategy as b, round(corr(a.ret, b.ret), 6) as corr from sleeves a join sleeves b using (date) group by 1, 2", "sleeves"))
def _(spark, sf):
    s = sleeves(spark, sf)
    both = s.select("date", F.col("strategy").alias("a"), F.col("ret").alias("x")).join(s.select("date", F.col("strategy").alias("b"), F.col("ret").alias("y")), "date")
    return rounded(both.groupBy("a", "b").agg(correlation(F.col("x"), F.col("y")).alias("c")), "a", "b", d=6, corr="c")


CTE["covs"] = ("sleeves", "select a.strategy as a, b.strategy as b, covar_samp(a.ret, b.ret) * 12 as cov from sleeves a join sleeves b using (date) group by 1, 2")


@query("a16_cov_matrix", sql("select a, b, round(cov, 8) + 0.0 as cov from covs", "covs"))
def _(spark, sf):
    return rounded(R.cov_table(sleeves(spark, sf), "strategy", "ret", 12), "a", "b", cov="cov")


@query("a17_portfolio_variance", sql("select round(sum(cov * 0.04), 8) as variance from covs", "covs"))
def _(spark, sf):
    s = sleeves(spark, sf)
    return rounded(R.portfolio_variance(R.cov_table(s, "strategy", "ret", 12), s.select(F.col("strategy").alias("key")).distinct().withColumn("w", F.lit(0.2))), variance="variance")


@query("a18_ensemble_compare", sql("select *, rank() over (order by sharpe desc) as place from (select strategy, round(avg(ret) / stddev_samp(ret) * sqrt(12), 6) + 0.0 as sharpe, count(*) as n from sleeves group by strategy)", "sleeves"))
def _(spark, sf):
    df = L.perf_stats(sleeves(spark, sf), 12, ("strategy",)).select("strategy", (F.round("sharpe", 6) + 0.0).alias("sharpe"), "n")
    return df.withColumn("place", F.rank().over(Window.orderBy(F.desc("sharpe"))).cast("long"))


@query("a19_score_adjustment", sql("select round(greatest(least(avg(s) - 1.5, 1), -1) - 2 * greatest(least(abs(min(d)) - 0.2, 0.5), 0), 6) + 0.0 as score from (select strategy, avg(ret) / stddev_samp(ret) * sqrt(12) as s, min(dd) as d from curves group by strategy)", "curves"))
def _(spark, sf):
    df = L.perf_stats(sleeves(spark, sf), 12, ("strategy",)).agg(F.avg("sharpe").alias("s"), F.abs(F.min("max_dd")).alias("d"))
    return rounded(df, d=6, score=clip(F.col("s") - 1.5, -1.0, 1.0) - 2 * clip(F.col("d") - 0.2, 0.0, 0.5))


@query("a20_market_series", sql("select date, round(avg(ret), 8) + 0.0 as market from ret_m where ret is not null group by date union all select min(date), 0.0 from px_m", "ret_m", "px_m"))
def _(spark, sf):
    m = ret_m(spark, sf).groupBy("date").agg(F.avg("ret").alias("m"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(m.withColumn("m", F.coalesce(F.last("m", ignorenulls=True).over(w), F.lit(0.0))), "date", market="m")


CURVE = {
    "total": "arg_max(eq, date) / arg_min(eq, date) - 1",
    "annualized": "pow(arg_max(eq, date) / arg_min(eq, date), 12.0 / count(r)) - 1",
    "sharpe": "avg(r) / (stddev_pop(r) + 1e-8) * sqrt(12)",
    "max_dd": "min(dd)",
    "vol": "stddev_pop(r) * sqrt(12)",
    "final": "arg_max(eq, date)",
}


@query("a21_value_curve_stats", sql("select strategy, " + ", ".join(f"round({e}, 6) + 0.0 as {k}" for k, e in CURVE.items()) + " from (select *, eq / lag(eq) over (partition by strategy order by date) - 1 as r from curves) group by strategy", "curves"))
def _(spark, sf):
    curve = W.drawdown(sleeves(spark, sf), "ret", ("strategy",)).select("strategy", "date", "equity")
    return rounded(R.value_curve_stats(curve, "equity", ["strategy"], 12), "strategy", d=6, **{k: k for k in CURVE})


Q_RANK = lambda c: f"rank() over (partition by date, sector order by {c}) + (count(*) over (partition by date, sector, {c}) - 1) / 2.0"


@query("a22_group_mean_ic", sql(f"select date, round(avg(ic), 6) + 0.0 as ic from (select date, sector, case when count(*) >= 3 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end as ic from (select date, sector, {Q_RANK('mom')} as a, {Q_RANK('fwd_ret')} as b from scores where mom is not null and fwd_ret is not null) group by date, sector) group by date", "scores"))
def _(spark, sf):
    return rounded(X.rank_ic(scores(spark, sf), "mom", "fwd_ret", 3, ("date", "sector")).groupBy("date").agg(F.avg("ic").alias("ic")), "date", d=6, ic="ic")


W_ALL = "(partition by strategy order by date rows between unbounded preceding and 1 preceding)"
CTE["vols"] = ("sleeves", f"select *, case when count(ret) over {W_ALL} >= 12 then stddev_samp(ret) over {W_ALL} end as v from sleeves")


@query("k10_risk_parity", sql("select date, strategy, round(case when bool_or(v is null) over (partition by date) then 1.0 / count(*) over (partition by date) else 1 / v / sum(1 / v) over (partition by date) end, 8) as w from vols", "vols"))
def _(spark, sf):
    d = Window.partitionBy("date")
    df = sleeves(spark, sf).withColumn("v", W.expanding_std(F.col("ret"), 12, ("strategy",)))
    w = F.when(F.bool_or(F.col("v").isNull()).over(d), 1 / F.count(F.lit(1)).over(d)).otherwise(1 / F.col("v") / F.sum(1 / F.col("v")).over(d))
    return rounded(df, "date", "strategy", w=w)


@query("k11_vol_target_overlay", sql(f"select date, strategy, round(case when count(ret) over {W_ALL} >= 12 then least(0.08 / (stddev_samp(ret) over {W_ALL} * sqrt(12)), 2) else 1 end, 8) as leverage from sleeves", "sleeves"))
def _(spark, sf):
    return rounded(sleeves(spark, sf), "date", "strategy", leverage=K.vol_target(F.col("ret"), 0.08, 2.0, 12, 12, ("strategy",)))


@query("k08_inverse_vol_size", sql("select asset, date, round(case when v > 0 then greatest(least(s * 0.1 / v, 0.25), -0.25) else 0 end, 8) + 0.0 as w from (select asset, date, (coalesce(sign(close / lag(close, 21) over (partition by asset order by i) - 1), 0) + coalesce(sign(close / lag(close, 63) over (partition by asset order by i) - 1), 0)) / 2 as s, case when count(ret) over w >= 2 then greatest(sqrt(252) * stddev_samp(ret) over w, 0.06) end as v from rd window w as (partition by asset order by i rows between 60 preceding and 1 preceding))", "rd"))
def _(spark, sf):
    df = ret_d(spark, sf)
    return rounded(df, "asset", "date", w=K.inverse_vol_size(W.trend_signal([21, 63]), W.past_vol(F.col("ret"), 60, 252, 0.06), 0.1, 0.25))


@query("k12_position_limits", sql("select date, asset, round(c / greatest(sum(abs(c)) over (partition by date), 1), 8) + 0.0 as w from (select date, asset, greatest(least(w, 0.04), -0.04) as c from book)", "book"))
def _(spark, sf):
    return rounded(K.position_limits(book(spark, sf), 0.04), "date", "asset", w="w")


@query("k14_rank_report", sql("select date, asset, rank() over (partition by date order by mom desc) as place, round(sum(mom) over (partition by date), 6) + 0.0 as net from scores where mom is not null", "scores"))
def _(spark, sf):
    d = Window.partitionBy("date")
    df = scores(spark, sf).where("mom is not null").withColumn("place", F.rank().over(d.orderBy(F.desc("mom"))).cast("long"))
    return rounded(df, "date", "asset", "place", d=6, net=F.sum("mom").over(d))


@query("k15_latest_snapshot", sql("select asset, max(date) as date, round(arg_max(close, date), 7) as close, case when arg_max(volume, date) > 700 then 'high' when arg_max(volume, date) < 300 then 'low' else 'mid' end as label from px_m group by asset", "px_m"))
def _(spark, sf):
    s = fx.px_m(spark, sf).groupBy("asset").agg(F.max("date").alias("date"), F.max_by(F.struct("close", "volume"), "date").alias("s"))
    label = F.when(F.col("s.volume") > 700, "high").when(F.col("s.volume") < 300, "low").otherwise("mid")
    return s.select("asset", "date", F.round("s.close", 7).alias("close"), label.alias("label"))


@query("b04_hedged_return", sql("select b.date, round(b.long_ret - m.bench - 0.003 * 21 / 252, 8) + 0.0 as hedged from bret b join (select date, avg(fwd_ret) as bench from scores group by date) m using (date)", "bret", "scores"))
def _(spark, sf):
    s = factor_panel(spark, sf)
    both = L.book_return(written(K.long_short(s, "composite")), s).join(s.groupBy("date").agg(F.avg("fwd_ret").alias("bench")), "date")
    return rounded(both, "date", hedged=F.col("long_ret") - F.col("bench") - 0.003 * 21 / 252)


@query("b06_attribution", sql("""select factor, date, round(sum(case when t <= k then fwd / k when b <= k then -fwd / k end), 8) + 0.0 as ret from (
    select factor, date, coalesce(fwd_ret, 0) as fwd, row_number() over (partition by factor, date order by z desc, asset) as t, row_number() over (partition by factor, date order by z, asset desc) as b, greatest(1, cast(floor(count(*) over (partition by factor, date) * 0.2 + 1e-9) as int)) as k, count(*) over (partition by factor, date) as n
    from (select date, asset, fwd_ret, unnest(['mom', 'low_vol', 'size']) as factor, unnest([mom_z, low_vol_z, size_z]) as z from factor_scores) where z is not null) where n >= 10 group by factor, date""", "factor_scores"))
def _(spark, sf):
    f = factor_panel(spark, sf)
    each = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(f"{c}_z").alias("z")) for c in ("mom", "low_vol", "size")])
    z = f.select("date", "asset", "fwd_ret", F.explode(each).alias("s")).select("date", "asset", "fwd_ret", "s.*")
    w = Window.partitionBy("factor", "date")
    p = z.where("z is not null").withColumns({"t": F.row_number().over(w.orderBy(F.desc("z"), "asset")), "u": F.row_number().over(w.orderBy("z", F.desc("asset"))), "n": F.count(F.lit(1)).over(w)}).withColumn("k", K.side("n", 0.2)).where("n >= 10")
    part = F.coalesce("fwd_ret", F.lit(0.0)) / F.col("k")
    return rounded(p.groupBy("factor", "date").agg(F.sum(F.when(F.col("t") <= F.col("k"), part).when(F.col("u") <= F.col("k"), -part)).alias("r")), "factor", "date", ret="r")


@query("b11_capacity_curve", sql("""select aum, round(avg(ret - drag) * 12, 6) + 0.0 as mean_ret, round(avg(drag), 8) as mean_drag from (
    select t.date, aum, sum(coalesce(case when adv > 0 then d * 0.02 * sqrt(d * aum / adv) end, 0)) as drag from (
      select bk.date, coalesce(x.asset, y.asset) as asset, abs(coalesce(x.w, 0) - coalesce(y.w, 0)) as d from nb x full join (select k + 1 as k, asset, w from nb) y on x.k = y.k and x.asset = y.asset join bk on bk.k = coalesce(x.k, y.k)) t
    left join (select asset, date, case when count(close * volume) over w >= 3 then avg(close * volume) over w end as adv from dense_m window w as (partition by asset order by i rows between 5 preceding and current row)) v using (date, asset),
    (select unnest([1e5::double, 1e6, 1e7]) as aum) group by t.date, aum) join ledger using (date) group by aum""", "ledger", "nb", "dense_m"))
def _(spark, sf):
    adv = fx.dense_m(spark, sf).select("asset", "date", W.adv_dollar(6, 3).alias("adv"))
    panel = factor_panel(spark, sf)
    weights = written(K.long_short(panel, "composite"))
    df = L.capacity_curve(weights, adv, ledger_of(panel, weights), [1e5, 1e6, 1e7], 1.0, 0.02, 12)
    return rounded(df, "aum", mean_ret=F.round("mean_ret", 6), mean_drag="mean_drag")


@query("x15_macro_tilt", sql("select sector, date, round((sector - 2) * z, 6) + 0.0 as tilt from (select date, (m2 - avg(m2) over w) / (stddev_samp(m2) over w + 1e-8) as z, count(m2) over w as n from macro window w as (order by date rows between 62 preceding and current row)), (select distinct sector from sector_of) where n >= 31", "macro", "sector_of"))
def _(spark, sf):
    z = fx.macro(spark, sf).withColumn("z", W.trailing_z("m2", 63, 31)).where("z is not null")
    return rounded(z.select("date", "z", F.explode(F.array(*map(F.lit, range(5)))).alias("sector")).join(fx.sector_of(spark, sf).select("sector").distinct(), "sector", "left_semi"), "sector", "date", d=6, tilt=(F.col("sector") - 2) * F.col("z"))


@query("x16_rotation_composite", sql("select date, asset, round(0.6 * zm + 0.4 * zv, 7) + 0.0 as score from (select date, asset, case when stddev_samp(mom) over d < 1e-12 or stddev_samp(mom) over d is null or count(mom) over d < 5 then 0 else (mom - avg(mom) over d) / stddev_samp(mom) over d end as zm, case when stddev_samp(low_vol) over d < 1e-12 or stddev_samp(low_vol) over d is null or count(low_vol) over d < 5 then 0 else (low_vol - avg(low_vol) over d) / stddev_samp(low_vol) over d end as zv from scores window d as (partition by date))", "scores"))
def _(spark, sf):
    return rounded(scores(spark, sf), "date", "asset", d=7, score=0.6 * X.zscore("mom") + 0.4 * X.zscore("low_vol"))


@query("e01_fama_macbeth_univariate", sql("select date, round(regr_slope(fwd_ret, coalesce(mom, 0)), 6) + 0.0 as slope from scores where fwd_ret is not null group by date having count(*) >= 10 and var_pop(coalesce(mom, 0)) > 0", "scores"))
def _(spark, sf):
    g = E.gram(scores(spark, sf), ["mom"], "fwd_ret", ["date"]).where("x1_1 - x0_1 * x0_1 / n > 1e-12")
    return rounded(E.solve(g, ["mom"], ["date"], 10).where("feature = 'mom'"), "date", d=6, slope="slope")


@query("e01_fama_macbeth")
def _(spark, sf):
    f = factor_panel(spark, sf)
    return E.solve(E.gram(f, ["mom_z", "low_vol_z", "size_z"], "fwd_ret", ["date"]), ["mom_z", "low_vol_z", "size_z"], ["date"], 8)


NW = "select strategy, ret - avg(ret) over (partition by strategy) as e, ret, date from sleeves"


@query("e02_newey_west", sql("select strategy, round(avg(ret), 8) + 0.0 as mean, round(avg(ret) * count(*) / sqrt(sum(e * e) + 1.5 * sum(e * l1) + 1.0 * sum(e * l2) + 0.5 * sum(e * l3)), 6) + 0.0 as t, count(*) as n from (select *, lag(e, 1) over w as l1, lag(e, 2) over w as l2, lag(e, 3) over w as l3 from nw window w as (partition by strategy order by date)) group by strategy", "sleeves", nw=NW))
def _(spark, sf):
    return rounded(E.newey_west(sleeves(spark, sf), "ret", ["strategy"], "date", 3), "strategy", "n", mean="mean", t=F.round("t", 6))


@query("e03_premia_report")
def _(spark, sf):
    f = factor_panel(spark, sf)
    slopes = E.solve(E.gram(f, ["mom_z", "low_vol_z", "size_z"], "fwd_ret", ["date"]), ["mom_z", "low_vol_z", "size_z"], ["date"], 8)
    full = P.segment(slopes, SPLIT).withColumn("segment", F.explode(F.array(F.col("segment"), F.lit("FULL"))))
    nw = E.newey_west(full, "slope", ["feature", "segment"], "date", 3)
    return nw.select("feature", "segment", (F.col("mean") * 12).alias("premium"), "t", "n")


#: Pairs are fitted on 24 months and judged on the next 12, window by window.
FORMATION, TRADING, ENTRY, EXIT, STOP, PAIR_COST = 24, 12, 2.0, 0.5, 3.5, 0.0005
CTE["fill_m"] = ("dense_m", "select asset, date, i, volume, case when i - max(case when close is not null then i end) over w <= 5 then last_value(close ignore nulls) over w end as close from dense_m window w as (partition by asset order by i rows unbounded preceding)")
CTE["pw"] = ("fill_m cal_m", "select asset, k, i, i >= 12 * k + 24 as trade, ln(close) as logp, nxt from (select *, lead(close) over (partition by asset order by i) / close - 1 as nxt from fill_m) join (select unnest(generate_series(0, ((select count(*) from cal_m) - 36) // 12)) as k) on i between 12 * k and 12 * k + 35")
CTE["logs"] = ("pw", "select p.k, p.asset, p.i, p.logp from pw p join (select k, asset from pw where not trade and logp is not null group by 1, 2 having count(*) = 24 and arg_max(logp, i) >= ln(5)) using (k, asset) where not trade")
CTE["fits"] = ("logs sector_of", "select x.k, p.a, p.b, corr(x.logp, y.logp) as c, regr_intercept(x.logp, y.logp) as alpha, regr_slope(x.logp, y.logp) as beta from (select a.asset as a, b.asset as b from sector_of a join sector_of b on a.sector = b.sector and a.asset < b.asset) p join logs x on x.asset = p.a join logs y on y.asset = p.b and y.k = x.k and y.i = x.i group by x.k, p.a, p.b having corr(x.logp, y.logp) >= 0.2 and regr_slope(x.logp, y.logp) > 0")
CTE["spreads"] = ("fits logs", "select f.k, f.a, f.b, x.i, x.logp - alpha - beta * y.logp as s from fits f join logs x on x.asset = f.a and x.k = f.k join logs y on y.asset = f.b and y.k = f.k and y.i = x.i")
CTE["ssteps"] = ("spreads", "select *, lag(ds) over (partition by k, a, b order by i) as ds1 from (select *, s - s1 as ds from (select *, lag(s) over (partition by k, a, b order by i) as s1 from spreads))")


def pair_rows(spark, sf):
    """(k, asset, i, trade, logp, nxt): filled log prices and the return to the next month, by window."""
    filled = P.ffill_limit(fx.dense_m(spark, sf), 5)
    nxt = F.lead("close").over(Window.partitionBy("asset").orderBy("i")) / F.col("close") - 1
    return written(E.window_rows(filled.select("asset", "i", F.log("close").alias("logp"), nxt.alias("nxt")), FORMATION, TRADING))


CRITICAL, LOW, HIGH, MOST = -2.86, 0.2, 63, 20


def formed(spark, sf, **more):
    """Rows by window, and the pairs fitted in each formation; more: of pair_fit."""
    rows = pair_rows(spark, sf)
    return rows, BL.pair_fit(rows.where("not trade"), fx.sector_of(spark, sf), FORMATION, 0.2, math.log(5), **more)


def fits_of(pairs, **decimals):
    """Pairs with what was found of them, rounded: as many rows as pairs, so in doubles."""
    return pairs.select("k", "a", "b", *[nearest(F.col(c), d).alias(c) for c, d in decimals.items()])


@query("e04_pair_cointegration", sql("select k, a, b, round(c, 6) as corr, round(alpha, 5) + 0.0 as alpha, round(beta, 6) as beta from fits", "fits"))
def _(spark, sf):
    return fits_of(formed(spark, sf)[1], corr=6, alpha=5, beta=6)


CTE["adf"] = ("ssteps", "select k, a, b, ((say * sbb - sby * sab) / det) / sqrt((syy - (say * sbb - sby * sab) / det * say - (sby * saa - say * sab) / det * sby) / (n - 3) * sbb / det) as t from (select *, saa * sbb - sab * sab as det from (select k, a, b, count(*) as n, covar_pop(s1, s1) * count(*) as saa, covar_pop(ds1, ds1) * count(*) as sbb, covar_pop(s1, ds1) * count(*) as sab, covar_pop(s1, ds) * count(*) as say, covar_pop(ds1, ds) * count(*) as sby, covar_pop(ds, ds) * count(*) as syy from ssteps where ds1 is not null group by k, a, b))")


@query("e05_adf_t", sql("select k, a, b, round(t, 5) as t from adf", "adf"))
def _(spark, sf):
    return fits_of(formed(spark, sf, test=True, fields=("t",))[1], t=5)


CTE["ou"] = ("ssteps", "select * from (select k, a, b, -ln(2.0) / ln(phi) as half_life, c / (1 - phi) as mu, sigma from (select k, a, b, regr_slope(s, s1) as phi, regr_intercept(s, s1) as c, stddev_samp(s) as sigma from ssteps group by k, a, b) where phi > 0 and phi < 1) where half_life between 0.2 and 63")
CTE["sel"] = ("fits adf ou", "select f.*, t, half_life, mu, sigma from fits f join adf using (k, a, b) join ou using (k, a, b) where t <= -2.86 qualify row_number() over (partition by k order by t, a, b) <= 20")


@query("e06_ou_fit", sql("select k, a, b, round(half_life, 5) as half_life, round(mu, 6) + 0.0 as mu, round(sigma, 6) as sigma from ou", "ou"))
def _(spark, sf):
    found = formed(spark, sf, test=True, keep=lambda p: p["half_life"].between(LOW, HIGH), fields=("half_life", "mu", "sigma"))[1]
    return fits_of(found, half_life=5, mu=6, sigma=6)


def traded(spark, sf):
    """Rows by window, the chosen pairs (at most 20 a window), and their z over the trading rows."""
    rows, best = formed(spark, sf, test=True, keep=lambda p: (p["t"] <= CRITICAL) & p["half_life"].between(LOW, HIGH), most=MOST)
    chosen = written(E.best_pairs(best, CRITICAL, LOW, HIGH, MOST))
    return rows, chosen, E.spread_zscores(chosen, rows.where("trade"))


CTE["zs"] = ("sel pw", "select f.k, f.a, f.b, half_life, x.i, (x.logp - alpha - beta * y.logp - mu) / sigma as z, (x.nxt - beta * y.nxt) / (1 + beta) as leg from sel f join pw x on x.asset = f.a and x.k = f.k and x.trade join pw y on y.asset = f.b and y.k = f.k and y.i = x.i")


@query("e07_spread_zscore", sql("select k, a, b, i, round(z, 5) + 0.0 as z from zs", "zs"))
def _(spark, sf):
    return rounded(traded(spark, sf)[2], "k", "a", "b", F.col("i").cast("long").alias("i"), d=5, z="z")


def tradable(z):
    """The trading rows but the last of each window; without a return to the next row nothing can be held."""
    inside = z.where(F.col("i") < F.col("k") * TRADING + FORMATION + TRADING - 1)
    return inside.withColumn("z", F.when(F.col("leg").isNotNull(), F.col("z")))


POSITION = "case when z.z is null or s.dead then 0 when s.pos = 0 and z.z > s.entry then -1 when s.pos = 0 and z.z < -s.entry then 1 when s.pos <> 0 and (abs(z.z) < 0.5 or abs(z.z) > 3.5) then 0 else s.pos end"
DEAD = "s.dead or (s.pos <> 0 and z.z is not null and abs(z.z) >= 0.5 and abs(z.z) > 3.5)"


def q_positions(body: str, grid: str, **more: str) -> str:
    """SQL over `pos` (entry, band, k, a, b, i, pos, leg): positions for each (entry, band) of a grid; band: longest half-life."""
    recursion = {
        "grid": grid,
        "zk": "select entry, band, k, a, b, i, leg, case when leg is not null then z end as z, row_number() over (partition by entry, band, k, a, b order by i) as r from zs, grid where i < 12 * k + 35 and half_life <= band",
        "p": f"select distinct entry, band, k, a, b, cast(0 as bigint) as i, cast(0 as bigint) as r, cast(0 as int) as pos, false as dead, cast(null as double) as leg from zk union all select s.entry, s.band, z.k, z.a, z.b, z.i, z.r, cast({POSITION} as int), {DEAD}, z.leg from p s join zk z on z.entry = s.entry and z.band = s.band and z.k = s.k and z.a = s.a and z.b = s.b and z.r = s.r + 1",
        "pos": "select * from p where r > 0",
        "prets": "select *, coalesce(pos * leg, 0) - 0.0005 * abs(pos - lag(pos, 1, 0) over (partition by entry, band, k, a, b order by r)) as ret from pos",
        "pbook": """select entry, band, date, i, n_open, ret from (select *, max(cast(ret <> 0 as int)) over (partition by entry, band order by i) as begun from (
            select g.entry, g.band, c.date, c.i, coalesce(b.n_open, 0) as n_open, coalesce(b.s / n.n, 0) as ret from grid g cross join (select distinct k, i from pw where trade) t join cal_m c using (i)
            left join (select entry, band, k, i, sum(ret) as s, count(*) filter (pos <> 0) as n_open from prets group by 1, 2, 3, 4) b on b.entry = g.entry and b.band = g.band and b.k = t.k and b.i = t.i
            left join (select band, k, count(*) as n from sel, (select distinct band from grid) where half_life <= band group by 1, 2) n on n.band = g.band and n.k = t.k)) where begun = 1""",
    }
    return sql(body, "zs", "cal_m", **recursion, **more).replace("with ", "with recursive ", 1)


ONE_RULE = "select 2.0::double as entry, 63.0::double as band"


@query("e08_pair_positions", q_positions("select k, a, b, i, pos from pos", ONE_RULE))
def _(spark, sf):
    return E.pair_positions(tradable(traded(spark, sf)[2]), ENTRY, EXIT, STOP)


@query("e10_pairs_book", q_positions("select date, n_open, round(ret, 8) + 0.0 as ret, round(1e6 * exp(sum(ln(1 + ret)) over (order by i rows unbounded preceding)), 2) as capital from pbook", ONE_RULE))
def _(spark, sf):
    rows, chosen, z = traded(spark, sf)
    returns = E.pair_returns(E.pair_positions(tradable(z), ENTRY, EXIT, STOP, carry=("leg",)), PAIR_COST)
    slots = chosen.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    book = E.pairs_book(returns, slots, rows.where("trade").select("k", "i").distinct())
    capital = 1e6 * F.exp(F.sum(F.log1p("ret")).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    dated = book.withColumn("capital", capital).join(calendar(fx.px_m(spark, sf)), "i")
    return dated.select("date", "n_open", (F.round("ret", 8) + 0.0).alias("ret"), F.round("capital", 2).alias("capital"))


GRID = [(entry, band) for entry in (1.5, 2.0, 2.5) for band in (0.5, 1.0, 63.0)]
SCORED = "select entry, band, round(sharpe, 6) + 0.0 as sharpe, round(total, 8) + 0.0 as total, n, row_number() over (order by round(sharpe, 6) desc nulls last, entry, band) as place from (select entry, band, case when stddev_samp(ret) > 0 then avg(ret) / stddev_samp(ret) * sqrt(12) end as sharpe, exp(sum(ln(1 + ret))) - 1 as total, count(*) as n from pbook group by entry, band)"


@query("m15_param_grid_eval", q_positions(SCORED, "select * from (values " + ", ".join(f"({e}::double, {b}::double)" for e, b in GRID) + ") t(entry, band)"))
def _(spark, sf):
    """Rules of entry and longest half-life, scored by the Sharpe ratio of their book and sorted: the grid is a column."""
    rows, chosen, z = traded(spark, sf)
    rules = F.explode(F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(b).alias("band")) for e, b in GRID])).alias("g")
    each = lambda df, *keep: df.select(*keep, rules).select(*keep, "g.*")
    by = ("entry", "band", *E.PAIR)
    ruled = each(tradable(z), *E.PAIR, "i", "z", "leg", "half_life").where("half_life <= band")
    returns = E.pair_returns(E.pair_positions(ruled, "entry", EXIT, STOP, by, ("leg",)), PAIR_COST, by)
    slots = each(chosen, "k", "half_life").where("half_life <= band").groupBy("entry", "band", "k").agg(F.count(F.lit(1)).alias("n"))
    book = E.pairs_book(returns, slots, each(rows.where("trade").select("k", "i").distinct(), "k", "i"), ("entry", "band"))
    s = F.stddev_samp("ret")
    scored = book.groupBy("entry", "band").agg(F.round(F.when(s > 0, F.avg("ret") / s * 12**0.5), 6).alias("sharpe"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("total"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("sharpe"), "entry", "band"))  # one row a rule
    return scored.select("entry", "band", (F.col("sharpe") + 0.0).alias("sharpe"), (F.round("total", 8) + 0.0).alias("total"), "n", place.cast("long").alias("place"))


@query("e09_walkforward_windows", sql("select k, s as first, s + 24 as trade, s + 36 as stop, count(*) as n from (select unnest(generate_series(0, (select count(*) from cal_m) - 36, 12)) as s), (select 1), cal_m c, lateral (select cast(s / 12 as bigint) as k) where c.i >= s and c.i < s + 36 group by all", "cal_m"))
def _(spark, sf):
    rows = E.window_rows(calendar(fx.px_m(spark, sf)), FORMATION, TRADING).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("k") * TRADING
    return rows.select("k", first.alias("first"), (first + FORMATION).alias("trade"), (first + FORMATION + TRADING).alias("stop"), "n")


TIMES = " + ".join(f"(u >= {least!r})::int" for least in E.DRAWS)


@query(
    "e11_bootstrap_ci",
    sql(
        "select strategy, round(quantile_cont(m, 0.025), 6) + 0.0 as low, round(quantile_cont(m, 0.975), 6) + 0.0 as high from means group by strategy",
        "sleeves",
        draws="select strategy, ret, sample, cast(('0x' || substr(md5('7:' || strategy || ':' || date || ':' || sample), 1, 8)) as bigint) / 4294967296.0::double as u from sleeves, (select unnest(generate_series(1, 500)) as sample)",
        means=f"select strategy, sample, sum(w * ret) / sum(w) as m from (select *, {TIMES} as w from draws) where w > 0 group by 1, 2",
    ),
)
def _(spark, sf):
    return rounded(E.bootstrap_mean(sleeves(spark, sf), "ret", ["strategy"], "date", 500, 7, 0.95), "strategy", d=6, low="low", high="high")


@query("x19_ic_decay", sql("select k, round(avg(ic), 6) + 0.0 as mean_ic from (select k, date, case when count(*) >= 10 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end as ic from (select k, date, rank() over (partition by k, date order by mom) + (count(*) over (partition by k, date, mom) - 1) / 2.0 as a, rank() over (partition by k, date order by f) + (count(*) over (partition by k, date, f) - 1) / 2.0 as b from h where mom is not null and f is not null) group by k, date) group by k", "scores", h="select *, exp(s) - 1 as f from (select k, date, asset, mom, case when count(fwd_ret) over (partition by k, asset order by i rows between current row and 2 following) >= 0 then null end as x, case when k = 1 then case when fwd_ret is not null then ln(1 + fwd_ret) end when k = 2 then ln(1 + fwd_ret) + ln(1 + lead(fwd_ret) over (partition by k, asset order by i)) else ln(1 + fwd_ret) + ln(1 + lead(fwd_ret) over (partition by k, asset order by i)) + ln(1 + lead(fwd_ret, 2) over (partition by k, asset order by i)) end as s from scores, (select unnest([1, 2, 3]) as k))"))
def _(spark, sf):
    df = scores(spark, sf).withColumn("h", W.multi_horizon("fwd_ret", 3))
    long = df.select("date", "asset", "mom", F.posexplode("h").alias("p", "f")).withColumn("k", F.col("p") + 1)
    ic = X.rank_ic(long, "mom", "f", 10, ("k", "date"))
    return rounded(ic.groupBy("k").agg(F.avg("ic").alias("m")), "k", d=6, mean_ic="m")
