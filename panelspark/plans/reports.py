"""Queries: full ledgers' statistics, layered books, macro tilts, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import clean as P
from panelspark.operators import construct as K
from panelspark.operators import indicators as I
from panelspark.operators import joins as J
from panelspark.operators import ledger as L
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.plans import fixtures as fx
from panelspark.plans import models, technical
from panelspark.plans.core import book, factor_panel, ledger_of, rounded, scores
from panelspark.plans.fixtures import CTE, sql
from panelspark.plans.registry import ORACLE_SQL, query
from panelspark.plans.research import SPLIT, sleeves
from panelspark.sources.shared import written

#: Filed flows: quarters, the year to date behind each, and years, with the forms that they come in.
CTE["flows"] = (
    "quarters",
    """select asset, cast(date_trunc('quarter', period_end) as date) as start, period_end as "end", period_end + cast(15 + asset % 45 as int) as filed, case when (asset + quarter(period_end)) % 7 = 0 then '10-Q/A' else '10-Q' end as form, 'Q' || quarter(period_end) as fp, revenue as val from quarters
    union all select asset, cast(date_trunc('year', period_end) as date), period_end, period_end + cast(15 + asset % 45 as int), '10-Q', 'Q' || quarter(period_end), sum(revenue) over (partition by asset, year(period_end) order by period_end) from quarters
    union all select asset, cast(date_trunc('year', max(period_end)) as date), max(period_end), max(period_end) + cast(15 + asset % 45 as int), '10-K', 'FY', sum(revenue) from quarters group by asset, year(period_end)""",
)
BANDS = {"Q": (60, 120), "F": (350, 380)}


def flows(spark, sf):
    q = written(fx.quarters(spark, sf))
    filed, year, number = F.expr(fx.FILED), F.trunc("period_end", "year"), F.concat(F.lit("Q"), F.quarter("period_end").cast("string"))
    form = F.when(F.expr(fx.RESTATED), "10-Q/A").otherwise("10-Q")
    names = lambda start, form, fp, val: [F.col("asset"), start.alias("start"), F.col("period_end").alias("end"), filed.alias("filed"), form.alias("form"), fp.alias("fp"), val.alias("val")]
    quarters = q.select(*names(F.trunc("period_end", "quarter"), form, number, F.col("revenue")))
    to_date = q.select(*names(year, F.lit("10-Q"), number, F.sum("revenue").over(Window.partitionBy("asset", F.year("period_end")).orderBy("period_end"))))
    years = q.groupBy("asset", F.year("period_end").alias("y")).agg(F.max("period_end").alias("period_end"), F.sum("revenue").alias("revenue"))
    return quarters.union(to_date).union(years.select(*names(year, F.lit("10-K"), F.lit("FY"), F.col("revenue"))))


@query("p10_duration_bands", sql("""select asset, start, "end", filed, form, fp, round(val, 3) as val from flows where form in ('10-Q', '10-K') and case when fp like 'Q%' then "end" - start between 60 and 120 when fp like 'F%' then "end" - start between 350 and 380 end""", "flows"))
def _(spark, sf):
    found = P.duration_bands(flows(spark, sf), ["10-Q", "10-K"], BANDS)
    return found.select("asset", "start", "end", "filed", "form", "fp", F.round("val", 3).alias("val"))


CTE["ledger_rows"] = (
    "path ics scores",
    "select p.date, period_return, capital, turnover, gross, long_ret, turnover * 0.001 as cost, ic, m.bench as benchmark_return, m.vol from path p join (select date, avg(fwd_ret) as bench, stddev_samp(fwd_ret) as vol from scores group by date) m using (date) left join ics using (date)",
)
PERF = {
    "total": "total", "bench_total": "bench_total", "excess": "total - bench_total", "annual": "pow(1 + total, 12.0 / n) - 1", "sharpe": "sharpe", "info_ratio": "info_ratio", "max_dd": "max_dd", "mean_ic": "mean_ic",
    "ic_hit": "ic_hit", "long_total": "long_total", "total_cost": "total_cost", "avg_turnover": "avg_turnover", "avg_gross": "avg_gross", "avg_vol": "avg_vol",
}


@query(
    "a12_ledger_perf",
    sql(
        "select n, " + ", ".join(f"round({e}, 6) + 0.0 as {k}" for k, e in PERF.items()) + """ from (select count(*) as n, arg_max(capital, date) / arg_min(capital, date) - 1 as total, product(1 + benchmark_return) - 1 as bench_total,
        avg(period_return) / stddev_samp(period_return) * sqrt(12) as sharpe, avg(period_return - benchmark_return) / stddev_samp(period_return - benchmark_return) * sqrt(12) as info_ratio, min(down) as max_dd, avg(ic) as mean_ic,
        avg(case when ic > 0 then 1.0 when ic is not null then 0.0 end) as ic_hit, sum(long_ret) as long_total, sum(cost) as total_cost, avg(turnover) as avg_turnover, avg(gross) as avg_gross, avg(vol) as avg_vol
        from (select *, capital / max(capital) over (order by date rows unbounded preceding) - 1 as down from ledger_rows) having count(*) >= 4)""",
        "ledger_rows",
    ),
)
def _(spark, sf):
    """The composite's book: returns, ratios, costs, turnover, exposure and the composite's ICs, all from one written panel."""
    panel = factor_panel(spark, sf)
    market = panel.groupBy("date").agg(F.avg("fwd_ret").alias("benchmark_return"), F.stddev_samp("fwd_ret").alias("vol"))
    ledger = ledger_of(panel, written(K.long_short(panel, "composite")))
    ics = X.rank_ic(panel, "composite", "fwd_ret").select("date", "ic")
    rows = ledger.withColumn("cost", F.col("turnover") * 0.001).join(market, "date").join(ics, "date", "left")
    return rounded(L.ledger_perf(rows, 12), "n", d=6, **{k: k for k in PERF})


@query(
    "b03_benchmark_asset",
    sql(
        "select date, round(coalesce(sum(l) over (order by i rows between 1 following and 3 following), 0), 8) + 0.0 as log_return, round(coalesce(lead(close, 3) over (order by i), last_value(close) over (order by i rows between current row and unbounded following)) / close - 1, 8) + 0.0 as simple_return from (select *, ln(close / lag(close) over (order by i)) as l from dense_m where asset = 1)",
        "dense_m",
    ),
)
def _(spark, sf):
    """The benchmark is one asset of the panel, held three months at a time."""
    return rounded(L.benchmark_windows(fx.dense_m(spark, sf), 1, 3), "date", log_return="log_return", simple_return="simple_return")


METRICS = {"total": "product(1 + ret) - 1", "sharpe": "avg(ret) / stddev_samp(ret) * sqrt(12)", "vol": "stddev_samp(ret) * sqrt(12)", "max_dd": "min(dd)"}
CTE["seg_dd"] = ("seg", "select *, eq / max(eq) over (partition by strategy, segment order by date rows unbounded preceding) - 1 as dd from (select *, exp(sum(ln(1 + ret)) over (partition by strategy, segment order by date rows unbounded preceding)) as eq from seg)")


@query(
    "m14_metric_changes",
    sql(
        "select strategy, metric, round(dev, 6) + 0.0 as dev, round(oos, 6) + 0.0 as oos, round(oos - dev, 6) + 0.0 as diff, round(case when dev <> 0 then (oos - dev) / abs(dev) end, 5) + 0.0 as share from (select strategy, metric, max(value) filter (segment = 'dev') as dev, max(value) filter (segment = 'oos') as oos from (select strategy, segment, unnest(["
        + ", ".join(f"'{k}'" for k in METRICS) + "]) as metric, unnest([" + ", ".join(METRICS.values()) + "]) as value from seg_dd group by 1, 2) group by 1, 2)",
        "seg_dd",
    ),
)
def _(spark, sf):
    stats = L.perf_stats(P.segment(sleeves(spark, sf), SPLIT), 12, ("strategy", "segment"))
    found = L.segment_changes(stats, "strategy", [*METRICS])
    return found.select("strategy", "metric", *[(F.round(c, 6) + 0.0).alias(c) for c in ("dev", "oos", "diff")], (F.round("share", 5) + 0.0).alias("share"))


FIVE = models.FIVE
CTE["five_fwd"] = ("five_scores scores", "select f.*, s.fwd_ret from five_scores f join scores s using (date, asset)")


@query("m13_factor_panel_five", sql("select date, asset, " + ", ".join(f"round({c}_z, 6) + 0.0 as {c}" for c in FIVE) + ", round(fwd_ret, 7) + 0.0 as fwd_ret from five_fwd where fwd_ret is not null and (" + " or ".join(f"{c}_z is not null" for c in FIVE) + ")", "five_fwd"))
def _(spark, sf):
    """The factor panel that models learn from: five scores and the next return, without rows that lack all scores or the return."""
    found = X.factor_scores(models.five_factors(spark, sf), [*FIVE], [*FIVE]).where("fwd_ret is not null").dropna(how="all", subset=[f"{c}_z" for c in FIVE])
    return found.select("date", "asset", *[(F.round(f"{c}_z", 6) + 0.0).alias(c) for c in FIVE], (F.round("fwd_ret", 7) + 0.0).alias("fwd_ret"))


#: Sensitivity of each sector to the two macro series.
BETAS = {0: (0.4, -0.2), 1: (-0.3, 0.1), 2: (0.0, 0.5), 3: (0.2, 0.3), 4: (-0.1, -0.4)}
CTE["macro_z"] = ("macro", "select date, (m1 - avg(m1) over w) / (stddev_samp(m1) over w + 1e-8) as m1, (m2 - avg(m2) over w) / (stddev_samp(m2) over w + 1e-8) as m2 from macro window w as (order by date rows between 62 preceding and current row) qualify count(*) over w >= 31")
CTE["tilts"] = ("macro_z", "select date, sector, b1 * m1 + b2 * m2 as tilt from macro_z, (values " + ", ".join(f"({s}, {a}::double, {b}::double)" for s, (a, b) in BETAS.items()) + ") t(sector, b1, b2)")


def tilts(spark, sf):
    macro = fx.macro(spark, sf)
    z = macro.select("date", *[W.trailing_z(c, 63, 31).alias(c) for c in ("m1", "m2")])
    betas = spark.createDataFrame([(s, *b) for s, b in BETAS.items()], "sector long, beta_m1 double, beta_m2 double")
    return X.macro_tilt(z, betas, ["m1", "m2"])


@query("x15_macro_tilt_two", sql("select date, sector, round(tilt, 6) + 0.0 as tilt from tilts", "tilts"))
def _(spark, sf):
    return rounded(tilts(spark, sf), "date", "sector", d=6, tilt="tilt")


def q_over(c: str) -> str:
    return f"case when stddev_samp({c}) over d > 1e-8 then ({c} - avg({c}) over d) / stddev_samp({c}) over d else 0 end"


CTE["sector_mom"] = ("scores", "select date, sector, avg(mom) as mom from scores group by 1, 2")
CTE["rotation"] = ("sector_mom tilts", f"select date, sector, 0.6 * ({q_over('mom')}) + 0.4 * ({q_over('tilt')}) as score from (select m.date, m.sector, coalesce(m.mom, 0) as mom, coalesce(t.tilt, 0) as tilt from sector_mom m asof left join tilts t on t.sector = m.sector and m.date >= t.date) window d as (partition by date)")


def rotated(spark, sf):
    """(date, sector, score): sector momentum and the macro tilt as last known, over the date's sectors."""
    mom = scores(spark, sf).groupBy("date", "sector").agg(F.avg("mom").alias("mom"))
    both = J.asof_join(mom, tilts(spark, sf), ["sector"], "date", ["tilt"])
    return X.rotation(both, {"mom": 0.6, "tilt": 0.4}, "score")


@query("x16_rotation_with_macro", sql("select date, sector, round(score, 6) + 0.0 as score from rotation", "rotation"))
def _(spark, sf):
    return rounded(rotated(spark, sf), "date", "sector", d=6, score="score")


CTE["layer"] = ("rotation", "select date, sector, f / sum(f) over (partition by date) as weight from (select *, greatest(e / sum(e) over (partition by date), 0.005) as f from (select *, exp(4 * score - max(4 * score) over (partition by date)) as e from (select *, rank() over (partition by date order by 4 * score desc) as r from rotation) where r <= 4))")
CTE["within"] = (
    "scores",
    "select date, sector, asset, v / sum(v) over (partition by date, sector) as within from (select *, 1 / greatest(coalesce(-low_vol, avg(-low_vol) over (partition by date, sector), 0.02), 0.02) as v from (select *, row_number() over (partition by date, sector order by mom desc, asset) as t, greatest(1, cast(floor(count(*) over (partition by date, sector) * 0.2 + 1e-9) as int)) as k from scores where mom is not null) where t <= k)",
)
CTE["two_layer"] = (
    "layer within",
    "select date, sector, asset, x / sum(x) over (partition by date) * total as w from (select date, sector, asset, weight * within as x, total from (select *, sum(weight) over (partition by date) as total from layer) join within using (date, sector) where weight >= 0.01)",
)


def two_layer_book(spark, sf):
    layer = X.softmax_topn(rotated(spark, sf).withColumn("s", 4 * F.col("score")), "s", 4, 0.005).select("date", "sector", "weight")
    names = K.inverse_vol_within(scores(spark, sf).withColumn("vol", -F.col("low_vol")), "mom", "vol", "sector", 0.2, 0.02)
    return K.two_layer(layer, names, "sector")


@query("k07_two_layer_book", sql("select date, sector, asset, round(w, 7) as w from two_layer", "two_layer"))
def _(spark, sf):
    """Sector weights from momentum and macro, names within sectors by inverse volatility, sectors under 1 % cut."""
    return rounded(two_layer_book(spark, sf), "date", "sector", "asset", d=7, w="w")


@query(
    "k14_signal_report",
    sql(
        "select date, round(sum(abs(w)), 6) as gross, round(sum(w), 6) + 0.0 as net, count(*) filter (w > 0.001) as n_long, round(coalesce(sum(w) filter (w > 0.001), 0), 6) as long_total, count(*) filter (w < -0.001) as n_short, round(coalesce(sum(w) filter (w < -0.001), 0), 6) + 0.0 as short_total, coalesce(string_agg(cast(asset as varchar), '|' order by w desc, asset) filter (w > 0.001), '') as longs, coalesce(string_agg(cast(asset as varchar), '|' order by w, asset) filter (w < -0.001), '') as shorts from book group by date",
        "book",
    ),
)
def _(spark, sf):
    found = K.signal_report(book(spark, sf))
    return rounded(found, "date", "n_long", "n_short", "longs", "shorts", d=6, **{c: c for c in ("gross", "net", "long_total", "short_total")})


LABELS = {
    "momentum": "case when rsi_14 >= 0.7 then 'overbought' when rsi_14 <= 0.3 then 'oversold' else 'neutral' end",
    "trend": "case when adx >= 0.25 then 'trending' else 'ranging' end",
    "band": "case when bb_up - bb_low = 0 then 'inside' when -bb_low / (bb_up - bb_low) > 1 then 'above' when -bb_low / (bb_up - bb_low) < 0 then 'below' else 'inside' end",
}
LATEST = f"select asset, max(date) as date from ({ORACLE_SQL['t03_adx']}) group by asset"


@query(
    "k15_indicator_snapshot",
    f"select asset, date, rsi_14, adx, bb_up, bb_low, {', '.join(f'{e} as {k}' for k, e in LABELS.items())} from (select asset, date, rsi_14 from ({ORACLE_SQL['t05_rsi']})) join (select asset, date, adx from ({ORACLE_SQL['t03_adx']})) using (asset, date) join (select asset, date, bb_up, bb_low from ({ORACLE_SQL['t09_bollinger']})) using (asset, date) join ({LATEST}) using (asset, date)",
)
def _(spark, sf):
    """Each asset's last bar with its indicators and what they are called."""
    bars = written(fx.ohlcv(spark, sf))
    last = bars.groupBy("asset").agg(F.max("date").alias("date"))
    each = rounded(I.recursive_set(bars), "asset", "date", d=technical.D, rsi_14="rsi_14", adx="adx").join(last, ["asset", "date"])
    both = each.join(rounded(I.window_set(bars), "asset", "date", d=technical.D, bb_up="bb_up", bb_low="bb_low"), ["asset", "date"])
    return both.select("asset", "date", "rsi_14", "adx", "bb_up", "bb_low", *[F.expr(e).alias(k) for k, e in LABELS.items()])
