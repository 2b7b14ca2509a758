"""Exact quantiles by distributed selection: ranges of values, counts of ranges, then the rows at the ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.shared import written


def exact_quantiles(df: DataFrame, value: str, by: list[str], levels: list[float]) -> DataFrame:
    """(by..., level, value): quantiles of each group, interpolated between the two rows at level * (n - 1).

    Equal values are counted first, so a value that many rows have is one row. Values are dealt to ranges in order; the
    counts of a group's ranges, a row each, tell which ranges hold the wanted ranks, and only these are ordered
    inside. No task holds a group. Null values are left out; a group without values has no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = written(counts.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()))
    each = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_m"))  # a row for each range of a group
    w = Window.partitionBy(*by)
    placed = each.withColumns({"_before": F.sum("_m").over(w.orderBy("_range")) - F.col("_m"), "_total": F.sum("_m").over(w)})
    at = F.col("level") * (F.col("_total") - 1)
    rank = F.explode(F.array(F.floor(at), F.ceil(at)))
    wanted = placed.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_part", at - F.floor(at)).withColumn("_rank", rank)
    wanted = wanted.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_m"))).distinct()
    keys = [*by, "_range"]
    other = [F.col(c).alias(f"_of_{c}") for c in keys]
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    need = wanted.select(*other, "_before").distinct()
    inside = ranged.join(need, same).select(*keys, "_v", "_n", "_before")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
    ordered = inside.withColumns({"_to": upto, "_from": upto - F.col("_n")}).drop("_before", "_n")
    ranks = wanted.select(*other, "level", "_part", "_rank")
    hits = ordered.join(ranks, [*same, F.col("_rank") >= F.col("_from"), F.col("_rank") < F.col("_to")]).select(*by, "level", "_part", "_rank", "_v")
    both = hits.groupBy(*by, "level", "_part").agg(F.min_by("_v", "_rank").alias("_low"), F.max_by("_v", "_rank").alias("_high"))
    return both.select(*by, "level", (F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).alias("value"))
