"""Panels, events and dimensions that are derived from the given tables, each as DataFrame and as DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.calendar import densify
from panelspark.sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(lineitem: DataFrame, asset: str, date) -> DataFrame:
    """(asset, date, close, volume): unit price and quantity by asset and date."""
    total = lineitem.groupBy(F.col(asset).alias("asset"), date.alias("date"))
    return total.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").cast("double").alias("volume"))


def px_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly panel of suppliers."""
    return px(table(spark, sf_dir, "lineitem"), "l_suppkey", F.trunc("l_shipdate", "month"))


def px_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel of brands."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return px(lines.join(brands, "l_partkey"), "p_brand", F.to_date("l_shipdate"))


def dense_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel on its calendar; lineitem is aggregated once and written, as four branches use the panel."""
    return densify(written(px_m(spark, sf_dir)))


def dense_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(written(px_d(spark, sf_dir)))


def sector_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, sector): a supplier's region."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("sector"))
    return table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("asset"), "sector")


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, period_end, revenue, quantity) by supplier and quarter."""
    lines = table(spark, sf_dir, "lineitem")
    end = F.date_sub(F.add_months(F.trunc("l_shipdate", "quarter"), 3), 1)
    total = lines.groupBy(F.col("l_suppkey").alias("asset"), end.alias("period_end"))
    return total.agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.sum("l_quantity").cast("double").alias("quantity"))


FILED = "date_add(period_end, cast(15 + asset % 45 as int))"
RESTATED = "(asset + quarter(period_end)) % 7 = 0"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, period_end, filed, form, val): revenue as first filed and, for some quarters, as restated."""
    q = quarters(spark, sf_dir)
    first = q.select("asset", "period_end", F.expr(FILED).alias("filed"), F.lit("10-Q").alias("form"), F.col("revenue").alias("val"))
    again = first.where(RESTATED).select("asset", "period_end", F.date_add("filed", 30).alias("filed"), F.lit("10-Q/A").alias("form"), (F.col("val") * 1.01).alias("val"))
    return first.unionByName(again)


def eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ann_date, eps): first filed revenue over quantity."""
    return quarters(spark, sf_dir).select("asset", F.expr(FILED).alias("ann_date"), F.expr("revenue / quantity").alias("eps"))


FACTS = {
    "sales": "sum(l_extendedprice * (1 - l_discount))",
    "gross": "sum(l_extendedprice * (1 - l_discount - l_tax))",
    "earnings": "sum(case when l_returnflag <> 'R' then l_extendedprice * (1 - l_discount - l_tax) else -l_extendedprice * l_tax end)",
    "book": "sum(case when l_linestatus = 'F' then l_extendedprice else 0.5 * l_extendedprice end)",
    "assets": "sum(l_extendedprice)",
}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, filed, sales, gross, earnings, book, assets): a supplier's quarter as filed."""
    lines = table(spark, sf_dir, "lineitem")
    end = F.date_sub(F.add_months(F.trunc("l_shipdate", "quarter"), 3), 1)
    total = lines.groupBy(F.col("l_suppkey").alias("asset"), end.alias("period_end")).agg(*[F.expr(e).alias(k) for k, e in FACTS.items()])
    return total.select("asset", F.expr(FILED).alias("filed"), *FACTS)


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, asset, filed, owner, shares, price, code, flag): lines of orders as filed transactions. A task keeps its orders, of
    which there are fewer than lines, in a hash table and streams their lines, so no lines are sorted."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    both = lines.join(orders.hint("shuffle_hash"), lines.l_orderkey == orders.o_orderkey)
    return both.select(
        F.col("o_orderkey").alias("order_id"), F.col("l_suppkey").alias("asset"), F.to_date("o_orderdate").alias("filed"), F.col("o_custkey").alias("owner"),
        F.col("l_quantity").cast("double").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("o_orderstatus").alias("code"), F.col("l_returnflag").alias("flag"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snap_date, tickers): at each quarter's start the suppliers in the top 60 % by that quarter's revenue, as one string."""
    q = quarters(spark, sf_dir).withColumn("snap_date", F.trunc("period_end", "quarter"))
    ranked = q.selectExpr("snap_date", "asset", "row_number() over (partition by snap_date order by revenue desc, asset) r", "count(*) over (partition by snap_date) n")
    top = ranked.where("r <= 0.6 * n").groupBy("snap_date").agg(F.sort_array(F.collect_list("asset")).alias("a"))
    return top.select("snap_date", F.array_join(F.col("a").cast("array<string>"), ",").alias("tickers"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, m1, m2): total and mean order value by day."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("m1"), F.avg("o_totalprice").alias("m2"))


def ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, open, high, low, close, volume): daily bars of brands from unit prices of their lines."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, sf_dir, "lineitem").join(brands, "l_partkey").withColumn("p", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return lines.groupBy(F.col("p_brand").alias("asset"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"), F.sum("l_quantity").cast("double").alias("volume")
    )


#: DuckDB: the same fixtures by name; each names the ones that it needs.
CTE: dict[str, tuple[str, str]] = {
    "px_m": ("", "select l_suppkey as asset, cast(date_trunc('month', l_shipdate) as date) as date, sum(l_extendedprice) / sum(l_quantity) as close, cast(sum(l_quantity) as double) as volume from lineitem group by 1, 2"),
    "px_d": ("", "select p_brand as asset, cast(l_shipdate as date) as date, sum(l_extendedprice) / sum(l_quantity) as close, cast(sum(l_quantity) as double) as volume from lineitem join part on l_partkey = p_partkey group by 1, 2"),
    **{
        k: v
        for x in ("m", "d")
        for k, v in {
            f"cal_{x}": (f"px_{x}", f"select date, row_number() over (order by date) - 1 as i from (select distinct date from px_{x})"),
            f"span_{x}": (f"px_{x} cal_{x}", f"select asset, min(i) as lo, max(i) as hi from px_{x} join cal_{x} using (date) group by asset"),
            f"dense_{x}": (f"px_{x} cal_{x} span_{x}", f"select s.asset, c.date, c.i, p.close, p.volume from span_{x} s join cal_{x} c on c.i between s.lo and s.hi left join px_{x} p on p.asset = s.asset and p.date = c.date"),
            f"ret_{x}": (f"dense_{x}", f"select *, close / lag(close) over (partition by asset order by i) - 1 as ret from dense_{x}"),
        }.items()
    },
    "sector_of": ("", "select s_suppkey as asset, n_regionkey as sector from supplier join nation on s_nationkey = n_nationkey"),
    "quarters": ("", "select l_suppkey as asset, cast(date_trunc('quarter', l_shipdate) + interval 3 month - interval 1 day as date) as period_end, sum(l_extendedprice * (1 - l_discount)) as revenue, cast(sum(l_quantity) as double) as quantity from lineitem group by 1, 2"),
    "facts": (
        "",
        "select asset, period_end + cast(15 + asset % 45 as int) as filed, " + ", ".join(FACTS) + " from (select l_suppkey as asset, cast(date_trunc('quarter', l_shipdate) + interval 3 month - interval 1 day as date) as period_end, " + ", ".join(f"{e} as {k}" for k, e in FACTS.items()) + " from lineitem group by 1, 2)",
    ),
    "filings": ("quarters", "select asset, period_end, period_end + cast(15 + asset % 45 as int) as filed, '10-Q' as form, revenue as val from quarters union all select asset, period_end, period_end + cast(15 + asset % 45 + 30 as int), '10-Q/A', revenue * 1.01 from quarters where (asset + quarter(period_end)) % 7 = 0"),
    "eps": ("quarters", "select asset, period_end + cast(15 + asset % 45 as int) as ann_date, revenue / quantity as eps from quarters"),
    "purchases": ("", "select o_orderkey as order_id, l_suppkey as asset, cast(o_orderdate as date) as filed, o_custkey as owner, cast(l_quantity as double) as shares, l_extendedprice / l_quantity as price, o_orderstatus as code, l_returnflag as flag from lineitem join orders on l_orderkey = o_orderkey"),
    "members": ("quarters", "select snap_date, string_agg(cast(asset as varchar), ',' order by asset) as tickers from (select cast(date_trunc('quarter', period_end) as date) as snap_date, asset, row_number() over (partition by date_trunc('quarter', period_end) order by revenue desc, asset) as r, count(*) over (partition by date_trunc('quarter', period_end)) as n from quarters) where r <= 0.6 * n group by 1"),
    "macro": ("", "select cast(o_orderdate as date) as date, sum(o_totalprice) as m1, avg(o_totalprice) as m2 from orders group by 1"),
    "ohlcv": ("", "select p_brand as asset, cast(l_shipdate as date) as date, arg_min(p, k) as open, max(p) as high, min(p) as low, arg_max(p, k) as close, cast(sum(l_quantity) as double) as volume from (select *, l_extendedprice / l_quantity as p, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as k from lineitem join part on l_partkey = p_partkey) group by 1, 2"),
}


def sql(body: str, *names: str, **more: str) -> str:
    """DuckDB SQL: body after the CTEs that it names and those given as keywords, in order."""
    parts: dict[str, str] = {}

    def put(name: str) -> None:
        before, text = CTE[name]
        for x in before.split():
            put(x)
        parts.setdefault(name, text)

    for n in names:
        put(n)
    parts |= more
    return ("with " + ", ".join(f"{k} as ({v})" for k, v in parts.items()) + " " if parts else "") + body
