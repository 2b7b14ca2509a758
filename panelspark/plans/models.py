"""Queries: walk-forward models, further ledgers, remaining features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.columns import clip, row_mean, safe_div
from panelspark.operators import construct as K
from panelspark.operators import blocks as BL
from panelspark.operators import features as FT
from panelspark.operators import joins as J
from panelspark.operators import ledger as L
from panelspark.operators import ml as M
from panelspark.operators import recurrence as RC
from panelspark.operators import regimes as RG
from panelspark.operators import stats as E
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.operators.calendar import calendar, next_trading_day
from panelspark.plans import fixtures as fx
from panelspark.plans.core import counted, factor_panel, q_rank, q_winsor, q_z, ret_d, ret_m, rounded, rows, scores
from panelspark.plans.fixtures import CTE, sql
from panelspark.plans.registry import query
from panelspark.plans.research import sleeves
from panelspark.sources.shared import WRITTEN, written

FEATURES = ["mom_z", "low_vol_z", "size_z"]


@query("m01_purged_splits", sql("select t.i as fold, 'train' as role, c.date from cal_m t join cal_m c on c.i < t.i - 1 where t.i >= 37 union all select i, 'test', date from cal_m where i >= 37", "cal_m"))
def _(spark, sf):
    df = M.purged_splits(calendar(fx.px_m(spark, sf)), 36, 1)
    return df.select(F.col("fold").cast("long").alias("fold"), "role", "date")


@query("m02_rolling_train_window", sql("select t.i as fold, c.date from cal_m t join cal_m c on c.i between t.i - 24 and t.i - 2 where t.i >= 24 and (t.i - 24) % 3 = 0", "cal_m"))
def _(spark, sf):
    df = M.rolling_train_rows(calendar(fx.px_m(spark, sf)), 24, 3, 1)
    return df.select(F.col("fold").cast("long").alias("fold"), "date")


@query("m03_combine_ew", sql("select date, asset, round((coalesce(mom_z, 0) + coalesce(low_vol_z, 0) + coalesce(size_z, 0)) / nullif((mom_z is not null)::int + (low_vol_z is not null)::int + (size_z is not null)::int, 0), 7) + 0.0 as pred from factor_scores", "factor_scores"))
def _(spark, sf):
    return rounded(factor_panel(spark, sf), "date", "asset", d=7, pred=row_mean(*FEATURES))


@query("m04_combine_ols")
def _(spark, sf):
    panel = factor_panel(spark, sf)
    return M.linear_predictions(panel, M.expanding_coefficients(panel, FEATURES, "fwd_ret", 36, 1), FEATURES).select("date", "asset", "pred")


@query("m04_combine_ols_single", sql("select date, asset, round(a + b * coalesce(mom, 0), 7) + 0.0 as pred from scores s join (select t.i, regr_intercept(h.fwd_ret, coalesce(h.mom, 0)) as a, regr_slope(h.fwd_ret, coalesce(h.mom, 0)) as b from (select distinct i from scores where i >= 37) t join scores h on h.i < t.i - 1 where h.fwd_ret is not null group by t.i) using (i)", "scores"))
def _(spark, sf):
    panel = scores(spark, sf)
    return rounded(M.linear_predictions(panel, M.expanding_coefficients(panel, ["mom"], "fwd_ret", 36, 1), ["mom"]), "date", "asset", d=7, pred="pred")


@query("m05_combine_ridge")
def _(spark, sf):
    return M.ridge_predictions(factor_panel(spark, sf), FEATURES, "fwd_ret", 36, 1, [0.1, 1.0, 10.0, 100.0, 1000.0]).select("date", "asset", "alpha", "pred")


def model_matrix(spark, sf):
    """(asset, date, i, sector, fwd_ret, ...): the feature panel, the sector's regime probabilities, zero where not yet known, the
    five factors' scores and composite, and the next month's return. Returns and facts as filed are written once for all of them."""
    rets, filed = written(ret_m(spark, sf)), written(fx.facts(spark, sf))
    factors = X.factor_scores(five_factors(spark, sf, rets, filed), [*FIVE], [*FIVE]).select("asset", "date", "i", "sector", "fwd_ret", "composite", *[f"{c}_z" for c in FIVE])
    features = FT.feature_panel(technical(spark, sf, rets), quarter_facts(spark, sf, filed)).select("asset", "date", *COLUMNS)
    probs = sector_regimes(spark, sf, rets).select("sector", "date", *[F.col("probs")[j].alias(c) for j, c in enumerate(REGIMES)])
    both = factors.join(features, ["asset", "date"], "left").join(probs, ["sector", "date"], "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in REGIMES})


REGIMES = ("regime_0", "regime_1", "regime_2")
#: Tables of boosted fits by session and folder of tables: three queries read one set of fits.
FITTED: dict[tuple[str, str], tuple] = {}


def boosted(spark, sf):
    """The model matrix, and predictions and importances of trees on all its features, fitted anew every 12 months from month 37."""
    key = (spark.sparkContext.applicationId, sf)
    tables = WRITTEN.setdefault(key[0], [])  # another list once they are cleared
    if key not in FITTED or FITTED[key][0] is not tables:
        panel = written(model_matrix(spark, sf))
        preds, weights = M.boosted_predictions(panel, [*COLUMNS, *REGIMES], "fwd_ret", 37, 12, 1)
        FITTED.clear()
        FITTED[key] = tables, panel, written(preds), written(weights)
    return FITTED[key][1:]


@query("m06_combine_gbt")
def _(spark, sf):
    return boosted(spark, sf)[1].select("fold", "date", "asset", "pred", "n_train", "last_train")


BAKED = "'2000-01-01'"


def q_bakeoff(preds: str) -> dict[str, str]:
    known = f"(select * from ({preds}) where pred is not null and fwd_ret is not null)"
    return {
        "ics": f"select model, date, case when count(*) >= 2 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end as ic from (select model, date, {q_rank('pred', 'model, date')} as a, {q_rank('fwd_ret', 'model, date')} as b from {known}) group by model, date",
        "lss": f"select model, date, avg(fwd_ret) filter (t <= k) - avg(fwd_ret) filter (b <= k) as ls from (select *, greatest(1, floor(n * 0.1 + 1e-9)) as k from (select *, row_number() over (partition by model, date order by pred desc, asset) as t, row_number() over (partition by model, date order by pred, asset desc) as b, count(*) over (partition by model, date) as n from {known})) group by model, date",
        "parts": f"select model, case when date < date {BAKED} then 'dev' else 'oos' end as segment, count(ic) as n, avg(ic) as mean_ic, case when count(ic) > 1 and stddev_samp(ic) > 0 then avg(ic) / stddev_samp(ic) * sqrt(count(ic)) end as ic_t, case when stddev_samp(ls) > 0 then avg(ls) / stddev_samp(ls) * sqrt(12) else 0 end as ls_sharpe, product(1 + ls) - 1 as ls_total from lss left join ics using (model, date) group by 1, 2",
    }


BAKEOFF = {c: f"round({c}, 6) + 0.0" for c in ("mean_ic", "ic_t", "ls_sharpe", "ls_total")} | {"lift": "round(ls_sharpe - max(case when model = 'ew' then ls_sharpe end) over (partition by segment), 6) + 0.0"}


def model_rows(df, model):
    return df.select(F.lit(model).alias("model"), "date", "asset", "fwd_ret", "pred")


def scored(preds):
    return rounded(M.bakeoff(preds, 0.1, BAKED.strip("'"), "ew"), "model", "segment", "n", d=6, **{c: c for c in BAKEOFF})


@query("m07_bakeoff_eval", sql("select model, segment, n, " + ", ".join(f"{v} as {k}" for k, v in BAKEOFF.items()) + " from parts", "scores", **q_bakeoff("select unnest(['ew', 'mom']) as model, date, asset, fwd_ret, unnest([(coalesce(mom, 0) + coalesce(low_vol, 0)) / nullif((mom is not null)::int + (low_vol is not null)::int, 0), mom]) as pred from scores where i >= 37")))
def _(spark, sf):
    """The evaluation alone, on two scores that SQL can say."""
    rows = written(scores(spark, sf).where("i >= 37"))
    return scored(model_rows(rows.withColumn("pred", row_mean("mom", "low_vol")), "ew").union(model_rows(rows.withColumn("pred", F.col("mom")), "mom")))


@query("m07_bakeoff")
def _(spark, sf):
    """Equal weights, least squares, ridge and boosted trees over the same months, purged by one month."""
    panel, trees, _ = boosted(spark, sf)
    names = [f"{c}_z" for c in FIVE]
    ols = M.linear_predictions(panel, M.expanding_coefficients(panel, names, "fwd_ret", 36, 1), names)
    ridge = M.ridge_predictions(panel, names, "fwd_ret", 36, 1, [0.1, 1.0, 10.0, 100.0, 1000.0])
    ew = panel.where("i >= 37").withColumn("pred", F.col("composite"))
    found = None
    for model, df in (("ew", ew), ("ols", ols), ("ridge", ridge), ("boosted", trees)):
        found = model_rows(df, model) if found is None else found.union(model_rows(df, model))
    return scored(written(found))


@query("m08_gbt_importance")
def _(spark, sf):
    return boosted(spark, sf)[2]


def sector_rows(spark, sf, rets=None):
    """(sector, i, date, ret, vol): a sector's mean return and its deviation over the last six months."""
    rets = (ret_m(spark, sf) if rets is None else rets).where("ret is not null").join(fx.sector_of(spark, sf), "asset")
    rows = rets.groupBy("sector", "i", "date").agg(F.avg(clip(F.col("ret"), -0.15, 0.15)).alias("ret"))
    past = Window.partitionBy("sector").orderBy("i").rowsBetween(-5, 0)
    return rows.withColumn("vol", F.when(F.count("ret").over(past) == 6, F.stddev_samp("ret").over(past)))


def sector_regimes(spark, sf, rets=None):
    """Three regimes of each sector, fitted anew every 12 months from month 36 on what was known by then."""
    return RG.walk_forward_regimes(sector_rows(spark, sf, rets), ["ret", "vol"], ["sector"], 3, 36, 12)


@query("m09_regime_labels")
def _(spark, sf):
    names = ("p_bear", "p_side", "p_bull")
    return sector_regimes(spark, sf).select("sector", "fold", "date", "regime", *[F.col("probs")[j].alias(n) for j, n in enumerate(names)])


@query("m10_regime_argmax")
def _(spark, sf):
    """The likeliest regime of m09, named, with its probability."""
    name = F.element_at(F.array(*map(F.lit, ("bear", "side", "bull"))), F.col("regime") + 1)
    return sector_regimes(spark, sf).select("sector", "date", name.alias("label"), F.round(F.array_max("probs"), 6).alias("prob"))


def sector_components(spark, sf):
    """Shares and scores of each sector's components over the months: returns clipped, unknown ones as the asset's mean."""
    rets = ret_m(spark, sf).select("asset", "i", clip(F.col("ret"), -0.15, 0.15).alias("ret")).where("ret is not null and i >= 1")
    n = rets.agg(F.max("i")).first()[0]  # the number of months, which bounds the vectors
    vectors = written(BL.standard_vectors(rets, "asset", "i", "ret", 1, n).join(fx.sector_of(spark, sf), "asset"))
    return BL.group_factors(written(BL.gram_rows(vectors, "sector", "v", n)), "sector", 3)


@query("m11_sector_pca")
def _(spark, sf):
    """Shares of variance of each sector's components, and of the global factors of their common factors."""
    shares, scores_ = sector_components(spark, sf)
    every = BL.global_factors(written(scores_), "sector", 5, 4)
    total = every.groupBy().agg(F.first("explained").alias("e")).select(F.lit("all").alias("sector"), F.posexplode("e").alias("component", "explained"))
    return shares.select(F.col("sector").cast("string").alias("sector"), "component", "explained").union(total)


@query("m11_global_factors")
def _(spark, sf):
    """The global factors by month: components of the common factors of all sectors' components."""
    found = BL.global_factors(written(sector_components(spark, sf)[1]), "sector", 5, 4)
    return found.select((F.col("row") + 1).alias("i"), *[F.col("factors")[j].alias(f"gf_{j + 1}") for j in range(4)])


def q_ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def q_clip(x: str, low: float, high: float) -> str:
    return f"(case when ({x}) is not null then least(greatest({x}, {low}), {high}) end)"


def q_change(c: str, k: int) -> str:
    return q_ratio(f"{c} - lag({c}, {k}) over w", f"abs(lag({c}, {k}) over w)")


def q_rows(agg: str, c: str, low: int, high: int, least: int) -> str:
    o = f"over (partition by asset order by date rows between {-low} preceding and {'current row' if not high else f'{-high} preceding'})"
    return f"case when count({c}) {o} >= {least} then {agg}({c}) {o} end"


QW = "window w as (partition by asset order by date)"
CTE["quarter_facts"] = ("facts eps", "select f.asset, f.filed as date, e.eps, f.sales, f.gross from facts f join eps e on e.asset = f.asset and e.ann_date = f.filed")
CTE["filed"] = ("quarter_facts", f"""select *, eps_growth_yoy - lag(eps_growth_yoy, 4) over w as eps_acceleration, {q_rows("sum", "s", -3, 0, 2)} as eps_revision_trend, {q_clip("revenue_growth_yoy - lag(revenue_growth_yoy) over w", -3, 3)} as revenue_acceleration, {q_clip("gross_margin - lag(gross_margin, 4) over w", -0.3, 0.3)} as gross_margin_expansion from (
    select *, {q_clip(q_change("eps_ttm", 4), -2, 10)} as eps_growth_yoy, {q_clip(q_ratio("eps - est", "abs(est)"), -2, 2)} as eps_surprise, {q_clip(q_change("est", 1), -2, 2)} as eps_revision, cast(sign(est - lag(est) over w) as double) as s, {q_clip(q_change("sales", 4), -1, 5)} as revenue_growth_yoy, {q_clip(q_ratio("gross", "sales"), 0, 1)} as gross_margin from (
    select *, {q_rows("sum", "eps", -3, 0, 4)} as eps_ttm, {q_rows("avg", "eps", -4, -1, 2)} as est from quarter_facts) {QW}) {QW}""")
CTE["sect"] = ("ret_m sector_of", "select sector, date, i, avg(ret) as sec from ret_m join sector_of using (asset) group by 1, 2, 3")
CTE["sect_v"] = ("sect", "select *, case when count(sec) over h >= 6 then stddev_samp(sec) over h end as v from sect window h as (partition by sector order by i rows between 5 preceding and current row)")
CTE["sect_p"] = ("sect_v", "select a.sector, a.date, a.i, a.sec, a.v, case when a.v is not null and count(b.v) >= 3 then (count(*) filter (b.v < a.v) + (count(*) filter (b.v = a.v) + 1) / 2.0) / count(b.v) end as p from sect_v a join (select *, row_number() over (partition by sector order by i) as r from sect_v) b on b.sector = a.sector join (select sector, i, row_number() over (partition by sector order by i) as r from sect_v) ar on ar.sector = a.sector and ar.i = a.i and b.r between ar.r - 11 and ar.r group by a.sector, a.date, a.i, a.sec, a.v")
CTE["sect_s"] = ("sect_p", "select sector, date, sec, lag(v) over w as sector_vol, lag(p) over w as sector_vol_pctile from sect_p window w as (partition by sector order by i)")
CTE["market_s"] = ("ret_m", f"select date, lag(m) over (order by i) as cs_dispersion, lag(b) over (order by i) as breadth_200d from (select *, case when count(d) over w >= 2 then avg(d) over w end as m from (select date, i, stddev_samp(ret) as d, avg(case when u > 0 then 1.0 else 0.0 end) as b from (select *, {counted('sum', 'ret', -9, 0)} as u from ret_m) group by 1, 2) window w as (order by i rows between 1 preceding and current row))")
ON_SECTOR = f"count(case when ret is not null then sec end) {rows(-24, -1)} >= 12 and var_samp(case when ret is not null then sec end) {rows(-24, -1)} > 1e-12"
TECHNICAL = {
    "idio_mom_1m": counted("sum", "e", -1, 0), "idio_mom_3m": counted("sum", "e", -2, 0), "idio_mom_6m": counted("sum", "e", -5, 0),
    "total_mom_1m": counted("sum", "x", -1, 0), "total_mom_3m": counted("sum", "x", -2, 0), "reversal_1w": "ret", "beta": "beta_",
    "mom_12_1": f"{counted('sum', 'ret', -11, 0)} - {counted('sum', 'ret', -1, 0)}", "sd": counted("stddev_samp", "ret", -5, 0),
    "high_52w_ratio": q_clip(f"cum / {counted('max', 'cum', -11, 0, 3)}", 0, 1), "rel_volume": f"{counted('avg', 'vol', -1, 0)} / ({counted('avg', 'vol', -5, 0)} + 1e-6)",
    "price_vol_corr": f"(case when count(case when dv is not null then ret end) {rows(-5, 0)} >= 6 then corr(ret, dv) {rows(-5, 0)} end)",
}
CTE["technical"] = ("ret_m sector_of sect_s market_s", f"""select asset, date, close, volume, {', '.join(f'lag({c}) over w as {c}' for c in TECHNICAL if c != 'sd')}, lag(sd) over w / (sector_vol + 1e-8) as vol_ratio, sector_vol_pctile, cs_dispersion, breadth_200d,
    case when date - min(case when close is not null then date end) over (partition by asset) > 0 then cast(date - min(case when close is not null then date end) over (partition by asset) as double) end as ipo_age_days from (
    select asset, date, i, close, volume, sector_vol, sector_vol_pctile, {', '.join(f'{e} as {c}' for c, e in TECHNICAL.items())} from (select *, ln(vol) - lag(ln(vol)) over (partition by asset order by i) as dv from (
    select *, case when {ON_SECTOR} then regr_slope(ret, sec) {rows(-24, -1)} end as beta_, case when {ON_SECTOR} then ret - regr_intercept(ret, sec) {rows(-24, -1)} - regr_slope(ret, sec) {rows(-24, -1)} * sec end as e, ret - sec as x,
    greatest(last_value(volume ignore nulls) over (partition by asset order by i rows unbounded preceding), 1) as vol, case when ret is not null then exp(sum(ret) over (partition by asset order by i rows unbounded preceding)) end as cum
    from ret_m join sector_of using (asset) join sect_s using (sector, date)))) join market_s using (date) window w as (partition by asset order by i)""")
CTE["features"] = ("technical filed", f"""select *, ({q_rank("trailing_pe")}) / count(trailing_pe) over (partition by date) as pe_rank_cs from (select *, {q_clip("trailing_pe / nullif(eps_growth_yoy * 100, 0)", 0, 20)} as peg_ratio from (
    select t.*, {', '.join(f'f.{c}' for c in FT.FILED)}, {q_clip("case when f.eps_ttm > 0 then t.close / f.eps_ttm end", 0, 200)} as trailing_pe, case when t.close is not null and t.volume is not null then ln(greatest(t.close * t.volume, 1e6)) end as log_market_cap from technical t asof left join filed f on f.asset = t.asset and t.date >= f.date))""")
VALUED = ("trailing_pe", "peg_ratio", "log_market_cap", "pe_rank_cs")
COLUMNS = [*FT.STOCK, *FT.MARKET, "sector_vol_pctile", "ipo_age_days", *FT.FILED, *VALUED]


def quarter_facts(spark, sf, filed=None):
    both = (fx.facts(spark, sf) if filed is None else filed).select("asset", F.col("filed").alias("date"), "sales", "gross").join(fx.eps(spark, sf).withColumnRenamed("ann_date", "date"), ["asset", "date"])
    return both.select("asset", "date", "eps", "sales", "gross")


def stock_panel(spark, sf, rets=None):
    return written((ret_m(spark, sf) if rets is None else rets).join(fx.sector_of(spark, sf), "asset"))


def technical(spark, sf, rets=None):
    return FT.technical_features(stock_panel(spark, sf, rets))


def feature_query(name: str, columns: list[str], source: str, build) -> None:
    @query(name, sql("select asset, date, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in columns) + f" from {source}", source))
    def _(spark, sf):
        return rounded(build(spark, sf), "asset", "date", d=6, **{c: c for c in columns})


feature_query("w21_derived", [c for c in FT.STOCK if c.startswith(("idio", "total")) or c in ("vol_ratio", "reversal_1w")], "technical", technical)
feature_query("w27_eps_growth", [c for c in FT.FILED if c.startswith("eps")], "filed", lambda spark, sf: FT.filed_features(quarter_facts(spark, sf)))
feature_query("w29_revenue_growth", [c for c in FT.FILED if not c.startswith("eps")], "filed", lambda spark, sf: FT.filed_features(quarter_facts(spark, sf)))
feature_query("w28_trailing_pe", [*VALUED], "features", lambda spark, sf: FT.valuation(J.asof_join(fx.dense_m(spark, sf), FT.filed_features(quarter_facts(spark, sf)), ["asset"], "date", [*FT.FILED])))


@query("m12_model_matrix")
def _(spark, sf):
    """All columns that the boosted trees learn from: m12's, and the regimes of m09."""
    return model_matrix(spark, sf).select("asset", "date", "i", "fwd_ret", *COLUMNS, *REGIMES)


feature_query("m12_feature_panel", COLUMNS, "features", lambda spark, sf: FT.feature_panel(technical(spark, sf), quarter_facts(spark, sf)))


@query("m13_factor_panel_build", sql("select date, asset, round(mom_z, 7) + 0.0 as mom, round(low_vol_z, 7) + 0.0 as low_vol, round(fwd_ret, 7) + 0.0 as fwd_ret from factor_scores where fwd_ret is not null and (mom_z is not null or low_vol_z is not null)", "factor_scores"))
def _(spark, sf):
    df = factor_panel(spark, sf).where("fwd_ret is not null").dropna(how="all", subset=["mom_z", "low_vol_z"])
    return rounded(df, "date", "asset", d=7, mom="mom_z", low_vol="low_vol_z", fwd_ret="fwd_ret")


@query("m14_is_oos_comparison", sql("select strategy, round(max(m) filter (segment = 'oos') - max(m) filter (segment = 'dev'), 8) + 0.0 as diff, round((max(m) filter (segment = 'oos') - max(m) filter (segment = 'dev')) / abs(max(m) filter (segment = 'dev')), 6) + 0.0 as share from (select strategy, segment, avg(ret) as m from seg group by 1, 2) group by strategy", "seg"))
def _(spark, sf):
    from panelspark.operators.clean import segment

    m = segment(sleeves(spark, sf), "1999-06-01").groupBy("strategy").pivot("segment", ["dev", "oos"]).agg(F.avg("ret"))
    return rounded(m, "strategy", diff=F.col("oos") - F.col("dev"), share=F.round(F.try_divide(F.col("oos") - F.col("dev"), F.abs("dev")), 6))


@query("m16_aligned_design", sql("select r.asset, r.date, round(r.ret, 8) + 0.0 as ret, round(coalesce(last_value(m.m1 ignore nulls) over (partition by r.asset order by r.i rows unbounded preceding), 0), 4) as m1, round(lead(r.ret) over (partition by r.asset order by r.i), 8) + 0.0 as target from ret_m r left join macro m using (date)", "ret_m", "macro"))
def _(spark, sf):
    df = ret_m(spark, sf).join(fx.macro(spark, sf).select("date", "m1"), "date", "left")
    m1 = F.coalesce(F.last("m1", ignorenulls=True).over(W.frame(Window.unboundedPreceding, 0)), F.lit(0.0))
    return df.select("asset", "date", (F.round("ret", 8) + 0.0).alias("ret"), F.round(m1, 4).alias("m1"), (F.round(W.lag("ret", -1), 8) + 0.0).alias("target"))


#: Trend book on daily brands: signals sized by past volatility, rebalanced every 21 rows, levered by past returns.
CTE["trend_w"] = ("rd", """select asset, date, i, cast(floor((i - 63) / 21) as bigint) as k, case when v > 0 then greatest(least(s * 0.1 / v, 0.25), -0.25) else 0 end as w from (
    select asset, date, i, (coalesce(sign(close / lag(close, 21) over (partition by asset order by i) - 1), 0) + coalesce(sign(close / lag(close, 63) over (partition by asset order by i) - 1), 0)) / 2 as s,
    case when count(ret) over w >= 2 then greatest(sqrt(252) * stddev_samp(ret) over w, 0.06) end as v from rd window w as (partition by asset order by i rows between 60 preceding and 1 preceding)) where i >= 63 and (i - 63) % 21 = 0""")
CTE["trend_h"] = ("rd", "select asset, cast(floor((i - 64) / 21) as bigint) as k, product(1 + coalesce(ret, 0)) - 1 as h from rd where i >= 64 group by 1, 2")
CTE["trend_u"] = ("trend_w trend_h", "select w.k, min(w.date) as date, sum(w.w * coalesce(h, 0)) as unlev from trend_w w left join trend_h h using (asset, k) group by w.k")
CTE["trend_l"] = ("trend_u", "select *, case when count(unlev) over p >= 6 and stddev_samp(unlev) over p > 0 then least(0.12 / (stddev_samp(unlev) over p * sqrt(12)), 3) else 1 end as lev from trend_u window p as (order by k rows between unbounded preceding and 1 preceding)")
CTE["trend_t"] = ("trend_w trend_l", "select coalesce(x.k, y.k) as k, sum(abs(coalesce(x.w, 0) - coalesce(y.w, 0))) as turnover from (select k, asset, w * lev as w from trend_w join trend_l using (k)) x full join (select k + 1 as k, asset, w * lev as w from trend_w join trend_l using (k)) y on x.k = y.k and x.asset = y.asset group by 1")


def trend_parts(spark, sf):
    d = ret_d(spark, sf)
    w = d.withColumn("w", K.inverse_vol_size(W.trend_signal([21, 63]), W.past_vol(F.col("ret"), 60, 252, 0.06), 0.1, 0.25))
    w = w.where("i >= 63 and (i - 63) % 21 = 0").select("asset", "date", "w", F.floor((F.col("i") - 63) / 21).alias("k"))
    h = d.where("i >= 64").groupBy("asset", F.floor((F.col("i") - 64) / 21).alias("k")).agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("h"))
    u = w.join(h, ["asset", "k"], "left").groupBy("k").agg(F.min("date").alias("date"), F.sum(F.col("w") * F.coalesce("h", F.lit(0.0))).alias("unlev"))
    return w, u.withColumn("lev", K.vol_target(F.col("unlev"), 0.12, 3.0, 6, 12, (), "k"))


@query("k09_book_vol_target", sql("select date, round(unlev, 8) + 0.0 as unlev, round(lev, 7) as lev from trend_l", "trend_l"))
def _(spark, sf):
    return trend_parts(spark, sf)[1].select("date", (F.round("unlev", 8) + 0.0).alias("unlev"), F.round("lev", 7).alias("lev"))


@query("b05_trend_ledger", sql("select date, round(turnover, 7) as turnover, round(lev * unlev - turnover * 0.0005, 8) + 0.0 as period_return, round(1e6 * exp(sum(ln(1 + lev * unlev - turnover * 0.0005)) over (order by k rows unbounded preceding)), 2) as capital from trend_l join trend_t using (k)", "trend_l", "trend_t"))
def _(spark, sf):
    w, u = trend_parts(spark, sf)
    levered = w.drop("date").join(u.select("k", "date", "lev"), "k").select("date", "asset", (F.col("w") * F.col("lev")).alias("w"))
    rows = u.join(L.turnover(levered), "date").withColumn("r", F.col("lev") * F.col("unlev") - F.col("turnover") * 0.0005)
    capital = 1e6 * F.exp(F.sum(F.log1p("r")).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("date", F.round("turnover", 7).alias("turnover"), (F.round("r", 8) + 0.0).alias("period_return"), F.round(capital, 2).alias("capital"))


@query("b13_parallel_strategies", sql("select strategy, date, round(sum(case when t <= k then coalesce(fwd_ret, 0) / k when b <= k then -coalesce(fwd_ret, 0) / k end), 8) + 0.0 as ret from (select strategy, date, fwd_ret, row_number() over (partition by strategy, date order by s desc, asset) as t, row_number() over (partition by strategy, date order by s, asset desc) as b, greatest(1, cast(floor(count(*) over (partition by strategy, date) * 0.2 + 1e-9) as int)) as k, count(*) over (partition by strategy, date) as n from (select unnest(['mom', 'size']) as strategy, date, asset, fwd_ret, unnest([mom, size]) as s from scores) where s is not null) where n >= 10 group by strategy, date", "scores"))
def _(spark, sf):
    s = scores(spark, sf)
    books = None
    for c in ("mom", "size"):
        one = K.long_short(s, c).withColumn("strategy", F.lit(c))
        books = one if books is None else books.unionByName(one)
    return rounded(L.book_return(books, s, ("strategy",)), "strategy", "date", ret="ret")


CTE["daily_w"] = ("rd", "select date, i, asset, 1.0 / count(*) over (partition by date) as w from (select date, i, asset, row_number() over (partition by date order by ret desc, asset) as r from rd where ret is not null and i % 5 = 0) where r <= 8")
CTE["daily"] = ("rd daily_w", """select d.date, d.i, sum(coalesce(w.w, 0) * coalesce(d.ret, 0)) as gross from rd d left join daily_w w on w.asset = d.asset and w.i = cast(floor((d.i - 1) / 5.0) as bigint) * 5 and d.i >= 1 group by d.date, d.i""")
CTE["daily_t"] = ("daily_w", "select coalesce(x.i, y.i) as i, sum(abs(coalesce(x.w, 0) - coalesce(y.w, 0))) as turnover from daily_w x full join (select i + 5 as i, asset, w from daily_w) y on x.i = y.i and x.asset = y.asset group by 1")


def daily_parts(spark, sf):
    d = ret_d(spark, sf)
    ranked = d.where("ret is not null and i % 5 = 0").withColumn("r", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("ret"), "asset"))).where("r <= 8")
    w = ranked.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("date"))).select("i", "date", "asset", "w")
    held = d.withColumn("at", F.when(F.col("i") >= 1, F.floor((F.col("i") - 1) / 5) * 5)).join(w.select(F.col("i").alias("at"), "asset", "w"), ["at", "asset"], "left")
    gross = held.groupBy("date", "i").agg(F.sum(F.coalesce("w", F.lit(0.0)) * F.coalesce("ret", F.lit(0.0))).alias("gross"))
    return w, gross


@query("b08_daily_ledger", sql("select date, round(gross - coalesce(turnover, 0) * 0.0015, 8) + 0.0 as net from daily left join daily_t using (i)", "daily", "daily_t"))
def _(spark, sf):
    w, gross = daily_parts(spark, sf)
    rows = gross.join(L.turnover(w.select("date", "asset", "w")), "date", "left")
    return rounded(rows, "date", net=F.col("gross") - F.coalesce("turnover", F.lit(0.0)) * 0.0015)


@query("b09_trade_log", sql("select date, round(turnover, 8) as turnover from daily_t join (select distinct i, date from daily_w) using (i) where turnover > 0.001", "daily_t", "daily_w"))
def _(spark, sf):
    w, _ = daily_parts(spark, sf)
    return rounded(L.turnover(w.select("date", "asset", "w")).where("turnover > 0.001"), "date", turnover="turnover")


@query("b12_fold_validation", sql("select fold, count(*) as n, round(avg(gross), 8) + 0.0 as mean_gross, round(avg(net), 8) + 0.0 as mean_net, round(sum(turnover), 6) + 0.0 as turnover, round(exp(sum(ln(1 + net))) - 1, 7) + 0.0 as total from (select cast(floor(i / (select cast(floor(count(*) / 5) as bigint) from daily)) as bigint) as fold, gross, coalesce(turnover, 0) as turnover, gross - coalesce(turnover, 0) * 0.0015 as net from daily left join daily_t using (i) where i < 5 * (select cast(floor(count(*) / 5) as bigint) from daily)) group by fold", "daily", "daily_t"))
def _(spark, sf):
    """The daily ledger of each of five contiguous folds; a fold carries in the book that the one before left."""
    w, gross = daily_parts(spark, sf)
    ledger = gross.join(L.turnover(w.select("date", "asset", "w")), "date", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    ledger = ledger.withColumn("net", F.col("gross") - F.col("turnover") * 0.0015)
    size = gross.agg(F.floor(F.count(F.lit(1)) / 5).alias("size"))  # one row
    folds = ledger.join(F.broadcast(size)).where("i < 5 * size").withColumn("fold", F.floor(F.col("i") / F.col("size")))
    found = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("gross").alias("g"), F.avg("net").alias("m"), F.sum("turnover").alias("t"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("r"))
    return rounded(found, "fold", "n", mean_gross="g", mean_net="m", turnover=F.round("t", 6), total=F.round("r", 7))


@query("k06_rank_invvol", sql("""select date, asset, round(w / sum(w) over (partition by date) * g, 8) as w from (select date, asset, g, least(s / sum(s) over (partition by date) * g, 0.2) as w from (
    select date, asset, greatest(least(0.15 / avg(v) over (partition by date), 1.0), 0.5) as g, (count(*) over (partition by date) - t + 1) * pow((1 / v) / avg(1 / v) over (partition by date), 0.3) as s from (
    select date, asset, t, coalesce(-low_vol, avg(-low_vol) over (partition by date)) as v from (select *, row_number() over (partition by date order by mom desc, asset) as t from scores where mom is not null) where t <= 8)))""", "scores"))
def _(spark, sf):
    df = scores(spark, sf).withColumn("v", -F.col("low_vol"))
    return rounded(K.rank_invvol(df, "mom", "v", 8, 0.3, 0.15, 0.5, 1.0, 0.2), "date", "asset", w="w")


@query("k07_two_layer_weights", sql("select date, asset, round(sw * within, 8) as w from (select date, asset, 0.2 as sw, 1.0 / k as within from (select *, row_number() over (partition by date, sector order by mom desc, asset) as t, greatest(1, cast(floor(count(*) over (partition by date, sector) * 0.2 + 1e-9) as int)) as k from scores where mom is not null) where t <= k)", "scores"))
def _(spark, sf):
    s = Window.partitionBy("date", "sector")
    rows = scores(spark, sf).where("mom is not null").withColumns({"t": F.row_number().over(s.orderBy(F.desc("mom"), "asset")), "n": F.count(F.lit(1)).over(s)}).withColumn("k", K.side("n", 0.2))
    return rounded(rows.where("t <= k"), "date", "asset", w=0.2 / F.col("k"))


CTE["state_moves"] = ("dense_m", "select asset, x, z, ya, yb from (select asset, ln(close) as x, ln(volume) as z, lead(ln(close)) over w - ln(close) as ya, lead(ln(volume)) over w - ln(volume) as yb from dense_m window w as (partition by asset order by i)) where x is not null and z is not null and ya is not null and yb is not null")
CTE["msums"] = ("state_moves", "select asset, target, count(*) as n, covar_pop(x, x) as xx, covar_pop(z, z) as zz, covar_pop(x, z) as xz, covar_pop(x, y) as xy, covar_pop(z, y) as zy, covar_pop(y, y) as yy, avg(x) as mx, avg(z) as mz, avg(y) as my from (select asset, x, z, unnest(['close', 'volume']) as target, unnest([ya, yb]) as y from state_moves) group by 1, 2 having count(*) >= 12")
CTE["mfit"] = ("msums", "select *, (xy * zz - zy * xz) / (xx * zz - xz * xz) as p, (zy * xx - xy * xz) / (xx * zz - xz * xz) as q from msums")


@query("e12_linear_transition", sql("select asset, target, round(p * 12, 5) + 0.0 as of_close, round(q * 12, 5) + 0.0 as of_volume, round((my - p * mx - q * mz) * 12, 4) + 0.0 as offset, round(greatest(1e-6, (yy - p * xy - q * zy) * 12), 5) as sigma2 from mfit", "mfit"))
def _(spark, sf):
    """Drift, offset and diffusion of the state (log price, log volume) of each asset, by Cramer's rule in the oracle."""
    df = fx.dense_m(spark, sf).select("asset", "i", F.log("close").alias("close"), F.log("volume").alias("volume"))
    steps = df.withColumns({f"next_{c}": F.lead(c).over(Window.partitionBy("asset").orderBy("i")) for c in ("close", "volume")})
    fit = E.transition_fit(steps, ["close", "volume"], ["asset"], 1 / 12, 12)
    drift = {f"of_{c}": F.round(F.col("drift")[j], 5) + 0.0 for j, c in enumerate(("close", "volume"))}
    return fit.select("asset", "target", *[v.alias(k) for k, v in drift.items()], (F.round("offset", 4) + 0.0).alias("offset"), F.round("sigma2", 5).alias("sigma2"))


@query("w02_sector_returns", sql("select sector, date, asset, round(ret, 8) + 0.0 as ret from ret_m join sector_of using (asset) where ret is not null", "ret_m", "sector_of"))
def _(spark, sf):
    return rounded(ret_m(spark, sf).where("ret is not null").join(fx.sector_of(spark, sf), "asset"), "sector", "date", "asset", ret="ret")


@query("w33_post_event_return", sql("select e.asset, e.ann_date, e.i + 3 as seen, round(product(1 + r.ret) - 1, 7) + 0.0 as after from (select e.asset, e.ann_date, min(c.i) as i from eps e join cal_m c on c.date >= e.ann_date group by 1, 2) e join ret_m r on r.asset = e.asset and r.i between e.i + 1 and e.i + 3 where r.ret is not null group by e.asset, e.ann_date, e.i", "eps", "ret_m"))
def _(spark, sf):
    e = fx.eps(spark, sf).select("asset", "ann_date", F.date_sub("ann_date", 1).alias("day"))
    cal = written(calendar(fx.px_m(spark, sf)))
    # The first calendar date on or after the announcement, by equality with the calendar's days.
    landed = next_trading_day(e, cal, "day").join(cal.select(F.col("date").alias("next_date"), "i"), "next_date")
    # The return is known, and may be used, only from its last row on: `seen`.
    steps = landed.select("asset", "ann_date", (F.col("i") + 3).cast("long").alias("seen"), F.explode(F.sequence(F.col("i") + 1, F.col("i") + 3)).alias("i"))
    met = steps.join(ret_m(spark, sf).where("ret is not null").select("asset", "i", "ret"), ["asset", "i"])
    return rounded(met.groupBy("asset", "ann_date", "seen").agg((F.product(1 + F.col("ret")) - 1).alias("a")), "asset", "ann_date", "seen", d=7, after="a")


@query("w34_earnings_features", sql("select asset, ann_date, round(case when est is not null then (eps - est) / greatest(abs(est), 1e-4) * 100 else 0 end, 4) + 0.0 as surprise, round(case when p1 is not null then least(greatest((eps - p1) / greatest(abs(p1), 1e-4), -5), 5) end, 6) + 0.0 as qoq, round(case when p4 is not null then least(greatest((eps - p4) / greatest(abs(p4), 1e-4), -5), 5) end, 6) + 0.0 as yoy from (select *, lag(eps) over w as p1, lag(eps, 4) over w as p4, case when count(eps) over b >= 2 then avg(eps) over b end as est from eps window w as (partition by asset order by ann_date), b as (partition by asset order by ann_date rows between 4 preceding and 1 preceding))", "eps"))
def _(spark, sf):
    growth = lambda k: clip((F.col("eps") - W.lag("eps", k, "ann_date")) / F.greatest(F.abs(W.lag("eps", k, "ann_date")), F.lit(1e-4)), -5.0, 5.0)
    # Without an estimate (here the mean of the quarters before) the actual stands in for it.
    est = F.coalesce(W.rolling(F.col("eps"), -4, -1, F.avg, 2, "ann_date"), F.col("eps"))
    surprise = (F.col("eps") - est) / F.greatest(F.abs(est), F.lit(1e-4)) * 100
    return rounded(fx.eps(spark, sf), "asset", "ann_date", d=6, surprise=F.round(surprise, 4), qoq=growth(1), yoy=growth(4))


@query("w35_decay_fill", sql("select asset, date, round(coalesce(last_value(s ignore nulls) over w * pow(0.85, i - max(case when s is not null then i end) over w), 0), 8) + 0.0 as score from (select *, case when volume > 600 then close / 1000 end as s from dense_m) window w as (partition by asset order by i rows unbounded preceding)", "dense_m"))
def _(spark, sf):
    df = fx.dense_m(spark, sf).withColumn("s", F.when(F.col("volume") > 600, F.col("close") / 1000).otherwise(0.0))
    return rounded(df, "asset", "date", score=W.decay_fill("s", 0.85))


#: Ratios of the last filed quarter: of the value factor to market value (close times volume), of the quality factor to each other.
VALUE = {"bp": ("book", "mcap"), "ep": ("earnings", "mcap"), "sp": ("sales", "mcap")}
QUALITY = {"gpa": ("gross", "assets"), "roe": ("earnings", "book")}
CTE["fund"] = ("dense_m facts", "select d.asset, d.date, d.close * d.volume as mcap, f.* exclude (asset, filed) from dense_m d asof left join facts f on d.asset = f.asset and d.date >= f.filed")


def q_mean_of_z(ratios: dict[str, tuple[str, str]], out: str) -> str:
    raw = ", ".join(f"{a} / nullif({b}, 0) as {k}" for k, (a, b) in ratios.items())
    wins = ", ".join(f"{q_winsor(k)} as {k}_w" for k in ratios)
    zs_ = ", ".join(f"case when {k}_w is not null then {q_z(k + '_w')} end as {k}_z" for k in ratios)
    mean = f"({' + '.join(f'coalesce({k}_z, 0)' for k in ratios)}) / nullif({' + '.join(f'({k}_z is not null)::int' for k in ratios)}, 0) as {out}"
    return f"select *, {mean} from (select *, {zs_} from (select *, {wins} from (select date, asset, {raw} from fund)))"


CTE["value_factor"] = ("fund", q_mean_of_z(VALUE, "value"))
CTE["quality_factor"] = ("fund", q_mean_of_z(QUALITY, "quality"))


def fundamentals(spark, sf):
    left = fx.dense_m(spark, sf).select("asset", "date", (F.col("close") * F.col("volume")).alias("mcap"))
    return J.asof_join(left, fx.facts(spark, sf).withColumnRenamed("filed", "date"), ["asset"], "date", [*fx.FACTS])


def with_ratios(df, ratios):
    return df.withColumns({k: safe_div(F.col(a), F.col(b)) for k, (a, b) in ratios.items()})


for key, ratios, out in (("x05_value_factor", VALUE, "value"), ("x06_quality_factor", QUALITY, "quality")):

    @query(key, sql(f"select date, asset, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in [*[f'{k}_z' for k in ratios], out])} from {out}_factor", f"{out}_factor"))
    def _(spark, sf, ratios=ratios, out=out):
        found = X.mean_of_zscores(with_ratios(fundamentals(spark, sf), ratios), [*ratios], out)
        return rounded(found, "date", "asset", d=6, **{c: c for c in [*[f"{k}_z" for k in ratios], out]})


FIVE = ("value", "quality", "mom", "low_vol", "size")


def five_factors(spark, sf, rets=None, filed=None):
    """Scores beside value and quality, over one panel: facts as filed are joined to the rows that have the other factors."""
    panel = written(scores(spark, sf, rets))
    left = panel.withColumn("mcap", F.col("close") * F.col("volume"))
    both = J.asof_join(left, (fx.facts(spark, sf) if filed is None else filed).withColumnRenamed("filed", "date"), ["asset"], "date", [*fx.FACTS])
    both = X.mean_of_zscores(X.mean_of_zscores(with_ratios(both, VALUE | QUALITY), [*VALUE], "value"), [*QUALITY], "quality")
    return written(both.select(*panel.columns, "value", "quality"))


CTE["five"] = ("scores value_factor quality_factor", "select s.*, v.value, q.quality from scores s left join value_factor v using (date, asset) left join quality_factor q using (date, asset)")
CTE["five_scores"] = (
    "five",
    f"select date, asset, {', '.join(f'{q_z(f"{c}_n")} as {c}_z' for c in FIVE)} from (select *, {', '.join(f'{c}_w - avg({c}_w) over (partition by date, sector) as {c}_n' for c in FIVE)} from (select *, {', '.join(f'{q_winsor(c)} as {c}_w' for c in FIVE)} from five))",
)
FIVE_MEAN = f"({' + '.join(f'coalesce({c}_z, 0)' for c in FIVE)}) / nullif({' + '.join(f'({c}_z is not null)::int' for c in FIVE)}, 0)"


@query("x10_factor_scores", sql(f"select date, asset, {', '.join(f'round({c}_z, 6) + 0.0 as {c}_z' for c in FIVE)}, round({FIVE_MEAN}, 6) + 0.0 as composite from five_scores", "five_scores"))
def _(spark, sf):
    """All five factors, each winsorised and neutralised by sector, and their mean."""
    found = X.factor_scores(five_factors(spark, sf), [*FIVE], [*FIVE])
    return rounded(found, "date", "asset", d=6, **{c: c for c in [*[f"{c}_z" for c in FIVE], "composite"]})


CTE["ewm"] = (
    "sleeves",
    "select * from (with recursive r as (select *, row_number() over (partition by strategy order by date) as k from sleeves), f as (select distinct strategy, cast(0 as bigint) as k, cast(0 as double) as a, cast(0 as double) as b from sleeves union all select r.strategy, r.k, a + 0.05::double * (ret - a), b + 0.05::double * (ret * ret - b) from f join r on r.strategy = f.strategy and r.k = f.k + 1) select r.strategy, r.date, r.ret, f.k, f.a, f.b from r join f on f.strategy = r.strategy and f.k = r.k - 1)",
)


@query("e13_differential_sharpe", sql("select strategy, date, round(case when k < 20 or b - a * a <= 1e-12 then 100 * ret else least(greatest((b * (ret - a) - 0.5 * a * (ret * ret - b)) / pow(b - a * a, 1.5), -10), 10) end, 6) + 0.0 as d from ewm", "ewm"))
def _(spark, sf):
    """From the moving first and second moments before each row; the first 1 / eta steps give 100 * r."""
    return RC.differential_sharpe(sleeves(spark, sf), "ret", ["strategy"], ["date"], 0.05).select("strategy", "date", (F.round("d", 6) + 0.0).alias("d"))


CTE["sector_w"] = ("scores", "select 'top' as model, date, i, asset, 1.0 / k as w from (select *, row_number() over (partition by date order by mom desc, asset) as t, greatest(1, cast(floor(count(*) over (partition by date) * 0.2 + 1e-9) as int)) as k from scores where mom is not null and i % 3 = 0) where t <= k union all select 'even', date, i, asset, 1.0 / count(*) over (partition by date) from scores where mom is not null and i % 3 = 0")


@query("b07_sector_ledger", sql("""select model, date, round(g - turnover * 0.001, 8) + 0.0 as net from (select w.model, w.date, sum(w.w * coalesce(l.s, 0)) as g from sector_w w left join (select asset, cast(floor((i - 1) / 3.0) as bigint) * 3 as i, sum(ln(1 + least(greatest(ret, -0.15), 0.15))) as s from ret_m where i >= 1 and ret is not null group by 1, 2) l using (asset, i) group by 1, 2)
    join (select coalesce(x.model, y.model) as model, coalesce(x.i, y.i) as i, sum(abs(coalesce(x.w, 0) - coalesce(y.w, 0))) as turnover from sector_w x full join (select model, i + 3 as i, asset, w from sector_w) y on x.model = y.model and x.i = y.i and x.asset = y.asset group by 1, 2) t using (model) join (select distinct date, i from sector_w) d using (date) where t.i = d.i""", "sector_w", "ret_m"))
def _(spark, sf):
    rows = scores(spark, sf).where("mom is not null and i % 3 = 0")
    d = Window.partitionBy("date")
    n = F.count(F.lit(1)).over(d)
    top = rows.withColumns({"t": F.row_number().over(d.orderBy(F.desc("mom"), "asset")), "n": n}).withColumn("k", K.side("n", 0.2)).where("t <= k").select(F.lit("top").alias("model"), "date", "i", "asset", (1 / F.col("k")).alias("w"))
    both = top.unionByName(rows.select(F.lit("even").alias("model"), "date", "i", "asset", (1 / n).alias("w")))
    logs = ret_m(spark, sf).where("i >= 1 and ret is not null").groupBy("asset", (F.floor((F.col("i") - 1) / 3) * 3).alias("i")).agg(F.sum(F.log1p(clip(F.col("ret"), -0.15, 0.15))).alias("s"))
    gross = both.join(logs, ["asset", "i"], "left").groupBy("model", "date").agg(F.sum(F.col("w") * F.coalesce("s", F.lit(0.0))).alias("g"))
    # Each model pays for its own trades.
    return rounded(gross.join(L.turnover(both, ("model",)), ["model", "date"]), "model", "date", net=F.col("g") - F.col("turnover") * 0.001)
