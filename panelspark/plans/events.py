"""Queries: sources, point-in-time joins, filings and insider events, sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelspark.functions.columns import keyword_sentiment
from panelspark.operators import calendar as C
from panelspark.operators import clean as P
from panelspark.operators import construct as K
from panelspark.operators import joins as J
from panelspark.operators import windows as W
from panelspark.plans import fixtures as fx
from panelspark.plans.core import rounded
from panelspark.plans.fixtures import CTE, sql
from panelspark.plans.registry import query
from panelspark.sources import files as S
from panelspark.sources.panels import Cache, lay_out
from panelspark.sources.shared import shared_folder


def scratch(spark) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/panelspark-{uuid.uuid4().hex}"


@query("s02_csv_round_trip", sql("select date, asset, close from (select date, asset, round(close, 7) as close from px_m)", "px_m"))
def _(spark, sf):
    path = scratch(spark)
    S.write_results(rounded(fx.px_m(spark, sf), "date", "asset", d=7, close="close"), path, "csv")
    return S.read_csv_indexed(spark, path, "date date, asset long, close double")


@query("s03_facts_json", sql("select cast(asset as varchar) as company, 'Revenue' as tag, period_end as \"end\", filed, form, round(val, 4) as val from filings", "filings"))
def _(spark, sf):
    path = scratch(spark)
    f = fx.filings(spark, sf)
    row = F.struct(F.lit(None).cast("string").alias("start"), F.col("period_end").cast("string").alias("end"), F.col("filed").cast("string").alias("filed"), "form", F.lit("Q").alias("fp"), F.round("val", 4).alias("val"))
    docs = f.groupBy(F.col("asset").cast("string").alias("company")).agg(F.collect_list(row).alias("rows"))
    facts = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenue"), F.struct(F.create_map(F.lit("USD"), F.col("rows")).alias("units"))))
    docs.select("company", facts.alias("facts")).write.json(path)
    return S.read_facts_json(spark, path).select("company", "tag", "end", "filed", "form", "val")


@query("s04_read_delimited", sql("select cast(order_id as varchar) as accession, cast(owner as varchar) as owner, case when flag <> 'N' then flag end as flag from purchases where code = 'P'", "purchases"))
def _(spark, sf):
    path = scratch(spark)
    p = fx.purchases(spark, sf).where("code = 'P'").select("order_id", "owner", F.when(F.col("flag") == "N", "NULL").otherwise(F.col("flag")).alias("flag"))
    p.write.csv(path, sep="\t", header=True)
    return S.read_delimited(spark, path, ["accession", "owner", "flag"])


@query("s05_resolve_columns", "select o_orderkey as accession, o_orderstatus as code, 0 as volume from orders")
def _(spark, sf):
    return S.resolve_columns(fx.table(spark, sf, "orders"), {"accession": ["O_ORDERKEY"], "code": ["trans_code", "O_OrderStatus"], "volume": ["vol"]}, {"volume": 0})


CTE["member_rows"] = ("members", "select snap_date, trim(replace(split_part(t, '-', 1), '.', '-')) as ticker from (select snap_date, unnest(string_split(tickers, ',')) as t from members)")


@query("s06_explode_membership", sql("select * from member_rows where ticker <> ''", "member_rows"))
def _(spark, sf):
    return S.explode_membership(fx.members(spark, sf))


@query("s07_normalize_symbols", "select distinct replace(upper(split_part(o_orderpriority, '-', 2)), '.', '-') as symbol from orders where regexp_full_match(upper(split_part(o_orderpriority, '-', 2)), '[A-Z]{2,5}(-[A-Z])?')")
def _(spark, sf):
    return S.normalize_symbols(fx.table(spark, sf, "orders").select(F.upper(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("s")), "s")


@query("s08_reshape", sql("select asset, date, 'close' as field, round(close, 7) as value from px_m union all select asset, date, 'volume', round(volume, 7) from px_m", "px_m"))
def _(spark, sf):
    return rounded(S.to_long(fx.px_m(spark, sf), ["asset", "date"], "field", "value"), "asset", "date", "field", d=7, value="value")


@query("s08_to_wide", sql("select asset, date, round(close, 7) as close, round(volume, 7) as volume from px_m", "px_m"))
def _(spark, sf):
    long = S.to_long(fx.px_m(spark, sf), ["asset", "date"], "field", "value")
    return rounded(S.to_wide(long, ["asset", "date"], "field", "value", ["close", "volume"]), "asset", "date", d=7, close="close", volume="volume")


@query("s09_write_results", sql("select date, count(*) as n from px_m group by date", "px_m"))
def _(spark, sf):
    path = scratch(spark)
    S.write_results(fx.px_m(spark, sf).withColumn("year", F.year("date")), path, by=["year"])
    return spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("s10_stale_keys", sql("select asset, max(filed) as last from filings group by asset having max(filed) < date '2002-02-20' - 10", "filings"))
def _(spark, sf):
    return S.stale_keys(fx.filings(spark, sf), "asset", "filed", "2002-02-20", 10)


@query("s10_refresh", sql("select asset, period_end, filed, form, round(val, 4) as val from filings", "filings"))
def _(spark, sf):
    """A cache in which a third of the assets end early and some are missing, after a refresh: what a rebuild would give."""
    every = fx.filings(spark, sf)
    cache = Cache(spark, scratch(spark), "asset", "filed")
    cache.rebuild(every.where("asset % 7 <> 3 and (asset % 3 <> 1 or filed < date '1996-01-01')"))
    cache.refresh(every, lambda keys: every.join(keys, "asset", "left_semi"), "1999-01-01", 60)
    return cache.read().select("asset", "period_end", "filed", "form", F.round("val", 4).alias("val"))


@query("s09_laid_out_panel", sql("select asset, date, round(ret, 8) + 0.0 as ret, round(avg(ret) over (partition by asset order by i rows between 2 preceding and current row), 8) + 0.0 as mean_ret from ret_m", "ret_m"))
def _(spark, sf):
    """Returns and their means over three months from the panel in buckets of assets: windows without an exchange."""
    panel = lay_out(fx.dense_m(spark, sf)).withColumn("ret", W.simple_return())
    return rounded(panel.withColumn("mean_ret", F.avg("ret").over(W.frame(-2, 0))), "asset", "date", ret="ret", mean_ret="mean_ret")


@query("s11_combine", sql("select asset, date, round(close, 7) as close, null::double as extra from px_m where close is not null union all select asset, date, null, round(volume, 7) from px_m", "px_m"))
def _(spark, sf):
    p = fx.px_m(spark, sf)
    return S.combine([rounded(p, "asset", "date", d=7, close="close"), rounded(p, "asset", "date", d=7, extra="volume")], ["close", "extra"])


CTE["last_filing"] = ("filings", "select asset, filed, max(val) as val from filings group by asset, filed")


def last_filing(spark, sf):
    return fx.filings(spark, sf).groupBy("asset", "filed").agg(F.max("val").alias("val"))


@query("j01_asof_join", sql("select d.asset, d.date, round(f.val, 4) as val from dense_m d asof left join last_filing f on d.asset = f.asset and d.date >= f.filed", "dense_m", "last_filing"))
def _(spark, sf):
    left = fx.dense_m(spark, sf).select("asset", "date")
    return rounded(J.asof_join(left, last_filing(spark, sf).withColumnRenamed("filed", "date"), ["asset"], "date", ["val"]), "asset", "date", d=4, val="val")


@query("j01_asof_join_strict_tolerance", sql("select d.asset, d.date, round(case when d.date - f.filed <= 20 then f.val end, 4) as val from dense_m d asof left join last_filing f on d.asset = f.asset and d.date > f.filed", "dense_m", "last_filing"))
def _(spark, sf):
    left = fx.dense_m(spark, sf).select("asset", "date")
    return rounded(J.asof_join(left, last_filing(spark, sf).withColumnRenamed("filed", "date"), ["asset"], "date", ["val"], strict=True, tolerance_days=20), "asset", "date", d=4, val="val")


@query("j01_asof_join_forward", sql("select d.asset, d.date, round(f.val, 4) as val from dense_m d asof left join last_filing f on d.asset = f.asset and d.date <= f.filed", "dense_m", "last_filing"))
def _(spark, sf):
    left = fx.dense_m(spark, sf).select("asset", "date")
    return rounded(J.asof_join(left, last_filing(spark, sf).withColumnRenamed("filed", "date"), ["asset"], "date", ["val"], direction="forward"), "asset", "date", d=4, val="val")


@query("j02_landing_join", sql("select d.asset, d.date, round(last_value(f.val ignore nulls) over (partition by d.asset order by d.i rows unbounded preceding), 4) as val from dense_m d left join (select asset, cast(date_trunc('month', filed) as date) as m, max(val) as val from filings group by 1, 2) f on f.asset = d.asset and f.m = d.date", "dense_m", "filings"))
def _(spark, sf):
    f = fx.filings(spark, sf).groupBy("asset", F.trunc("filed", "month").alias("m")).agg(F.max("val").alias("val"))
    return rounded(J.landing_join(fx.dense_m(spark, sf), f, "m", ["val"]), "asset", "date", d=4, val="val")


CTE["rebal"] = ("cal_m", "select date, i from cal_m where i >= 12 and (i - 12) % 3 = 0")
CTE["met"] = ("rebal cal_m purchases", "select r.date, p.asset, p.owner, p.filed, p.shares, p.price from rebal r join cal_m c on c.i = greatest(0, r.i - 4) join purchases p on p.filed > c.date and p.filed < r.date and p.code = 'P' and p.flag = 'A'")


def met(spark, sf):
    bought = P.purchase_filter(fx.purchases(spark, sf)).select("asset", "owner", "filed", "shares", "price")
    px = fx.px_m(spark, sf)
    return J.event_window_join(C.rebalance_calendar(px, 12, 3), px, bought, "filed", 4)


@query("j04_event_window_join", sql("select date, asset, owner, filed, shares from met", "met"))
def _(spark, sf):
    return met(spark, sf).select("date", "asset", "owner", "filed", "shares")


@query("j05_member_semi_join", sql("select p.asset, p.date from px_m p where exists (select 1 from member_rows m where m.snap_date = cast(date_trunc('quarter', p.date) as date) and m.ticker = cast(p.asset as varchar))", "px_m", "member_rows"))
def _(spark, sf):
    px = fx.px_m(spark, sf).withColumn("snap_date", F.trunc("date", "quarter")).withColumn("ticker", F.col("asset").cast("string"))
    return px.join(S.explode_membership(fx.members(spark, sf)), ["snap_date", "ticker"], "left_semi").select("asset", "date")


@query("p07_pit_universe", sql("select asset, date from (select *, count(*) over (partition by date) as n from (select p.asset, p.date from px_m p where p.close is not null and exists (select 1 from member_rows m where m.snap_date = cast(date_trunc('quarter', p.date) as date) and m.ticker = cast(p.asset as varchar)))) where n >= 55", "px_m", "member_rows"))
def _(spark, sf):
    px = fx.px_m(spark, sf)
    quarters = S.explode_membership(fx.members(spark, sf)).select("snap_date", F.col("ticker").cast("long").alias("asset"))
    months = px.select("date").distinct().withColumn("snap_date", F.trunc("date", "quarter"))
    return P.pit_universe(px, months.join(quarters, "snap_date").select("date", "asset"), 55).select("asset", "date")


@query("j06_routine_flag", sql("select p.order_id, p.owner, p.filed, exists (select 1 from m where m.owner = p.owner and m.mo = month(p.filed) and m.y = year(p.filed) - 1) and exists (select 1 from m where m.owner = p.owner and m.mo = month(p.filed) and m.y = year(p.filed) - 2) as is_routine from p", p="select o_orderkey as order_id, o_custkey as owner, cast(o_orderdate as date) as filed from orders", m="select distinct owner, year(filed) as y, month(filed) as mo from p"))
def _(spark, sf):
    p = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("filed"))
    return J.routine_flag(p)


CTE["agg"] = ("purchases", "select order_id, asset, sum(shares) as shares, sum(shares * price) as value, avg(price) as price, min(filed) as filed from purchases where code = 'P' group by order_id, asset")


@query("a01_accession_agg", sql("select order_id, asset, filed, shares, round(value, 4) as value, round(price, 7) as price from agg", "agg"))
def _(spark, sf):
    p = fx.purchases(spark, sf).where("code = 'P'")
    a = p.groupBy("order_id", "asset").agg(F.sum("shares").alias("shares"), F.sum(F.coalesce(F.col("shares") * F.col("price"), F.lit(0.0))).alias("value"), F.avg("price").alias("price"), F.min("filed").alias("filed"))
    return a.select("order_id", "asset", "filed", "shares", F.round("value", 4).alias("value"), F.round("price", 7).alias("price"))


@query("a02_owner_agg", sql("select asset, min(owner) as first_owner, bool_or(flag = 'R') as any_flag from purchases group by asset", "purchases"))
def _(spark, sf):
    return fx.purchases(spark, sf).groupBy("asset").agg(F.min("owner").alias("first_owner"), F.bool_or(F.col("flag") == "R").alias("any_flag"))


@query("j07_filing_merge", "select l.l_orderkey as accession, l.l_linenumber as line, l.l_partkey as part, o.o_orderstatus as code, coalesce(c.c_custkey, l.l_orderkey) as owner, coalesce(c.c_mktsegment = 'BUILDING', false) as is_officer from lineitem l join orders o on l_orderkey = o_orderkey left join customer c on c_custkey = o_custkey and c_acctbal > 0")
def _(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_orderstatus").alias("code"), "o_custkey")
    owners = fx.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("owner"), (F.col("c_mktsegment") == "BUILDING").alias("is_officer"))
    owned = orders.join(owners, "o_custkey").select("accession", "owner", "is_officer")
    return J.filing_merge(lines, orders.drop("o_custkey"), owned, "accession").select("accession", "line", "part", "code", "owner", "is_officer")


CTE["clusters"] = ("met", "select date, asset, count(distinct owner) as n_buyers, sum(shares * price) as value from met group by date, asset having count(distinct owner) >= 2")


def clusters(spark, sf):
    return met(spark, sf).groupBy("date", "asset").agg(F.countDistinct("owner").alias("n_buyers"), F.sum(F.col("shares") * F.col("price")).alias("value")).where("n_buyers >= 2")


@query("a03_cluster_buys", sql("select date, asset, n_buyers, round(value, 3) as value from clusters", "clusters"))
def _(spark, sf):
    return rounded(clusters(spark, sf), "date", "asset", "n_buyers", d=3, value="value")


@query("k05_topk_multi_key", sql("select date, asset, round(1.0 / count(*) over (partition by date), 8) as w from (select *, row_number() over (partition by date order by n_buyers desc, value desc, asset) as r from clusters) where r <= 10", "clusters"))
def _(spark, sf):
    return rounded(K.topk(clusters(spark, sf), 10, F.desc("n_buyers"), F.desc("value"), F.asc("asset")), "date", "asset", w="w")


@query("j10_pairs_within_group", sql("select a.sector, a.asset as a, b.asset as b from sector_of a join sector_of b on a.sector = b.sector and a.asset < b.asset", "sector_of"))
def _(spark, sf):
    return J.pairs_within(fx.sector_of(spark, sf))


@query("j12_dimension_precedence", "select s_suppkey as asset, case when s_acctbal > 5000 then 'seed' when s_acctbal > 0 then n_name else 'Unknown' end as sector from supplier join nation on s_nationkey = n_nationkey")
def _(spark, sf):
    supplier = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").alias("n_nationkey"), "s_acctbal")
    cached = supplier.where("s_acctbal > 0").join(fx.table(spark, sf, "nation"), "n_nationkey").select("asset", F.col("n_name").alias("sector"))
    seed = supplier.where("s_acctbal > 5000").select("asset", F.lit("seed").alias("sector"))
    return J.with_dimension(supplier.select("asset"), seed, cached, "asset", "sector")


@query("j13_context_broadcast", sql("select p.asset, p.date, round(m1, 4) as m1 from px_d p left join macro using (date)", "px_d", "macro"))
def _(spark, sf):
    return rounded(fx.px_d(spark, sf).join(fx.macro(spark, sf), "date", "left"), "asset", "date", d=4, m1="m1")


@query("j11_panel_left_join", sql("select p.asset, p.date, round(p.close, 7) as close, round(q.revenue, 4) as revenue from px_m p left join quarters q on q.asset = p.asset and q.period_end = last_day(p.date)", "px_m", "quarters"))
def _(spark, sf):
    q = fx.quarters(spark, sf).select("asset", F.trunc("period_end", "month").alias("date"), "revenue")
    return fx.px_m(spark, sf).join(q, ["asset", "date"], "left").select("asset", "date", F.round("close", 7).alias("close"), F.round("revenue", 4).alias("revenue"))


CTE["sector_px"] = ("px_m sector_of", "select sector, date, avg(close) as close from px_m join sector_of using (asset) group by 1, 2")


@query("j09_multi_series_inner", sql("select date, " + ", ".join(f"round(s{k}.close, 6) as s{k}" for k in range(5)) + " from (select * from sector_px where sector = 0) s0 " + " ".join(f"join (select * from sector_px where sector = {k}) s{k} using (date)" for k in range(1, 5)), "sector_px"))
def _(spark, sf):
    px = fx.px_m(spark, sf).join(fx.sector_of(spark, sf), "asset").groupBy("sector", "date").agg(F.avg("close").alias("close"))
    return J.inner_align([px.where(f"sector = {k}").select("date", F.round("close", 6).alias(f"s{k}")) for k in range(5)])


@query("w23_trailing_macro_z", sql("select date, round((m1 - avg(m1) over w) / (stddev_samp(m1) over w + 1e-8), 6) + 0.0 as z from (select *, row_number() over (order by date) as k from macro) window w as (order by k rows between 62 preceding and current row) qualify count(m1) over w >= 31", "macro"))
def _(spark, sf):
    return rounded(fx.macro(spark, sf).withColumn("z", W.trailing_z("m1", 63, 31)).where("z is not null"), "date", d=6, z="z")


@query("w24_ttm_sum", sql("select asset, ann_date, round(sum(eps) over w * 4 / count(eps) over w, 6) as ttm, round(sum(eps) over w, 6) as partial from eps window w as (partition by asset order by ann_date rows between 3 preceding and current row)", "eps"))
def _(spark, sf):
    return rounded(fx.eps(spark, sf), "asset", "ann_date", d=6, ttm=W.ttm_sum("eps", 4, "ann_date"), partial=W.ttm_sum("eps", 4, "ann_date", "sum"))


CTE["sue"] = ("eps", "select asset, ann_date, eps, case when sd <> 0 then greatest(least(change / sd, 8), -8) end as sue from (select *, case when count(change) over w >= 4 then stddev_samp(change) over w end as sd from (select *, eps - lag(eps, 4) over (partition by asset order by ann_date) as change from eps) window w as (partition by asset order by ann_date rows between 7 preceding and current row))")


def sue(spark, sf):
    df = fx.eps(spark, sf)
    for name, c in W.sue("eps", "ann_date").items():
        df = df.withColumn(name, c)
    return df


@query("w25_sue", sql("select asset, ann_date, round(sue, 6) + 0.0 as sue from sue", "sue"))
def _(spark, sf):
    return rounded(sue(spark, sf), "asset", "ann_date", d=6, sue="sue")


@query("w26_latest_per_key", sql("select asset, period_end, filed, form from (select *, row_number() over (partition by asset, period_end order by filed desc) as r from filings) where r = 1", "filings"))
def _(spark, sf):
    return W.latest(fx.filings(spark, sf), ["asset", "period_end"], F.col("filed"), F.col("val")).select("asset", "period_end", "filed", "form")


@query("x20_event_avg_by_leg", sql("select ann_date, round(avg(case when sue > 1 then sue end), 6) as long_sue, round(avg(case when sue < -1 then sue end), 6) as short_sue from sue group by ann_date", "sue"))
def _(spark, sf):
    return sue(spark, sf).groupBy("ann_date").agg(F.round(F.avg(F.when(F.col("sue") > 1, F.col("sue"))), 6).alias("long_sue"), F.round(F.avg(F.when(F.col("sue") < -1, F.col("sue"))), 6).alias("short_sue"))


@query("u01_ever_members", sql("select distinct ticker from member_rows where snap_date between date '1996-01-01' and date '1996-12-31' + 400", "member_rows"))
def _(spark, sf):
    return S.explode_membership(fx.members(spark, sf)).where("snap_date between date '1996-01-01' and date_add(date '1996-12-31', 400)").select("ticker").distinct()


@query("u02_intersect_universe", sql("select asset from px_m where date = date '1997-04-01' intersect select asset from eps where year(ann_date) = 1997 intersect select asset from sector_of where sector < 3", "px_m", "eps", "sector_of"))
def _(spark, sf):
    priced = fx.px_m(spark, sf).where("date = date '1997-04-01'").select("asset")
    return priced.intersect(fx.eps(spark, sf).where("year(ann_date) = 1997").select("asset")).intersect(fx.sector_of(spark, sf).where("sector < 3").select("asset"))


@query("u03_missing_keys", "select o_custkey as owner from orders except select c_custkey from customer where c_acctbal > 0")
def _(spark, sf):
    owners = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("owner")).distinct()
    return owners.join(fx.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("owner")), "owner", "left_anti")


@query("u04_index_union", sql("select date, asset from px_m where volume > 800 union select date, asset from px_m where close < 1400", "px_m"))
def _(spark, sf):
    px = fx.px_m(spark, sf)
    return px.where("volume > 800").select("date", "asset").union(px.where("close < 1400").select("date", "asset")).distinct()


@query("u05_common_dates", sql("select cast(l_shipdate as date) as date from lineitem join sector_of on asset = l_suppkey group by 1 having count(distinct sector) = 5", "sector_of"))
def _(spark, sf):
    days = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("asset"), F.to_date("l_shipdate").alias("date"))
    return days.join(fx.sector_of(spark, sf), "asset").groupBy("date").agg(F.countDistinct("sector").alias("n")).where("n = 5").select("date")


WORDS = (["that", "with"], ["this", "from"])


@query("f01_keyword_sentiment", "select doc_id, round(case when b + d > 0 then (b - d) / (b + d) else 0 end, 8) + 0.0 as score from (select doc_id, " + ", ".join("(" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)}" for w in ws) + f") as {n}" for ws, n in zip(WORDS, ("b", "d"), strict=True)) + " from documents)")
def _(spark, sf):
    return rounded(fx.table(spark, sf, "documents"), "doc_id", score=keyword_sentiment(F.col("text"), *WORDS))


@query("a08_daily_text_score", """with t as (select source as asset, date '2024-01-01' + cast(doc_id % 60 as int) as date, """ + "".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)}.0 {s} " for w, s in (("that", "+"), ("with", "-"), ("this", "-"), ("from", "as net"))) + """ from documents),
    spine as (select asset, cast(d as date) as date from (select distinct asset from t), (select unnest(generate_series(date '2024-01-01', date '2024-02-29', interval 1 day)) as d) where isodow(d) < 6)
    select s.asset, s.date, round(coalesce(avg(t.net), 0), 6) + 0.0 as score from spine s left join t using (asset, date) group by s.asset, s.date""")
def _(spark, sf):
    low = F.lower("text")
    hits = lambda w: (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    docs = fx.table(spark, sf, "documents").select(F.col("source").alias("asset"), F.expr("date_add(date '2024-01-01', cast(doc_id % 60 as int))").alias("date"), (hits("that") + hits("with") - hits("this") - hits("from")).alias("net"))
    daily = docs.groupBy("asset", "date").agg(F.avg("net").alias("score"))
    days = F.explode(F.expr("filter(sequence(date '2024-01-01', date '2024-02-29'), d -> weekday(d) < 5)"))
    spine = docs.select("asset").distinct().select("asset", days.alias("date"))
    return rounded(spine.join(daily, ["asset", "date"], "left"), "asset", "date", d=6, score=F.coalesce("score", F.lit(0.0)))


@query("f02_tag_merge", sql("select asset, period_end, form, round(val, 4) as val from (select *, row_number() over (partition by asset, period_end order by case form when '10-Q/A' then 0 else 1 end) as r from filings) where r = 1", "filings"))
def _(spark, sf):
    ranked = fx.filings(spark, sf).withColumn("priority", F.when(F.col("form") == "10-Q/A", 1).otherwise(0))
    return rounded(W.latest(ranked, ["asset", "period_end"], F.col("priority")), "asset", "period_end", "form", d=4, val="val")
