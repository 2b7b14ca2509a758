"""Linear recurrences over long series: blocks are composed as affine maps, scanned, then replayed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.sources.shared import written


def affine_scan(df: DataFrame, by: list[str], order: list[str], terms: dict[str, tuple[Column, Column]], start: float = 0.0) -> DataFrame:
    """df with, for each name of terms, the state before each row of its series: states begin at `start`, and a row turns
    x into factor * x + shift, for the (factor, shift) of the name.

    Rows are dealt to ranges of (by, order), so a long series is many blocks. A block's rows compose to one affine map;
    the maps of a series' blocks, a row each, are scanned in order; each block is then replayed from its own start. No task
    holds a series. Null factors and shifts leave the state as it is. by may be empty.
    """
    names, kept = [*terms], [*df.columns, *terms]
    cols = {f"_{part}_{n}": c.cast("double") for n, pair in terms.items() for part, c in zip("fs", pair, strict=True)}
    dealt = df.withColumns(cols).repartitionByRange(*by, *order).withColumn("_block", F.spark_partition_id())
    laid = written(dealt)
    kinds = [laid.schema[b] for b in by]
    doubles = lambda prefix: [T.StructField(f"{prefix}{n}", T.DoubleType()) for n in names]

    def steps(rows: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
        f, s = rows[f"_f_{name}"].to_numpy(float), rows[f"_s_{name}"].to_numpy(float)
        skip = np.isnan(f) | np.isnan(s)
        return np.where(skip, 1.0, f), np.where(skip, 0.0, s)

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        out = rows[[*by, "_block"]].iloc[:1].copy()
        for n in names:
            a, b = 1.0, 0.0
            for f, s in zip(*steps(rows, n), strict=True):
                a, b = f * a, f * b + s
            out[f"_a_{n}"], out[f"_b_{n}"] = a, b
        return out

    def scanned(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block", kind="stable")
        for n in names:
            x, begin = start, []
            for a, b in zip(blocks[f"_a_{n}"], blocks[f"_b_{n}"], strict=True):
                begin.append(x)
                x = a * x + b
            blocks[f"_x_{n}"] = begin
        return blocks[[*by, "_block", *[f"_x_{n}" for n in names]]]

    def replayed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        for n in names:
            x, before = float(rows[f"_x_{n}"].iloc[0]), []
            for f, s in zip(*steps(rows, n), strict=True):
                before.append(x)
                x = f * x + s
            rows[n] = before
        return rows[kept]

    block = T.StructField("_block", T.IntegerType())
    maps = laid.select(*by, *order, "_block", *cols).groupBy(*by, "_block").applyInPandas(composed, T.StructType([*kinds, block, *doubles("_a_"), *doubles("_b_")]))
    begins = maps.groupBy(*by).applyInPandas(scanned, T.StructType([*kinds, block, *doubles("_x_")]))
    same = [laid[c].eqNullSafe(begins[c]) for c in (*by, "_block")]
    ready = laid.join(begins, same).select(*[laid[c] for c in laid.columns], *[f"_x_{n}" for n in names])
    return ready.groupBy(*by, "_block").applyInPandas(replayed, T.StructType([*df.schema.fields, *doubles("")]))


def differential_sharpe(df: DataFrame, r: str, by: list[str], order: list[str], eta: float, most: float = 10.0) -> DataFrame:
    """Df with d, the change of the Sharpe ratio by each return, from the moving first and second moments before it,
    within most; the first 1 / eta rows of a series, and rows without variance, give 100 * r."""
    x = F.col(r)
    found = affine_scan(df, by, order, {"_a": (F.lit(1 - eta), eta * x), "_b": (F.lit(1 - eta), eta * x * x), "_k": (F.lit(1.0), F.lit(1.0))})
    var = F.col("_b") - F.col("_a") * F.col("_a")
    change = (F.col("_b") * (x - F.col("_a")) - 0.5 * F.col("_a") * (x * x - F.col("_b"))) / F.pow(var, F.lit(1.5))
    d = F.when((F.col("_k") < 1 / eta - 1e-9) | (var <= 1e-12), 100 * x).otherwise(F.least(F.greatest(change, F.lit(-most)), F.lit(most)))
    return found.withColumn("d", d).drop("_a", "_b", "_k")
