"""Walk-forward evaluation and models on panels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.boosting import boost_each, predicted
from panelspark.operators.clean import segment
from panelspark.operators.stats import gram, solve
from panelspark.operators.xsection import rank_ic


def purged_splits(months: DataFrame, min_train: int, embargo: int) -> DataFrame:
    """(fold, role, date): fold i tests month i, i >= min_train + embargo, and trains on months before i - embargo.
    months: (date, i). Expanding, so quadratic in months by definition."""
    tests = months.where(F.col("i") >= min_train + embargo).select(F.col("i").alias("fold"))
    test = months.select("date", F.col("i").alias("fold")).where(F.col("fold") >= min_train + embargo).withColumn("role", F.lit("test"))
    spans = tests.select("fold", F.explode(F.sequence(F.lit(0), F.col("fold") - embargo - 1)).alias("i"))
    train = spans.join(months, "i").withColumn("role", F.lit("train"))
    return train.select("fold", "role", "date").union(test.select("fold", "role", "date"))


def rolling_train_rows(months: DataFrame, length: int, every: int, purge: int = 0) -> DataFrame:
    """(fold, date): every `every`-th month from `length` on, and the months [fold - length, fold - 1 - purge] before it."""
    folds = months.where((F.col("i") >= length) & ((F.col("i") - length) % every == 0)).select(F.col("i").alias("fold"))
    return folds.select("fold", F.explode(F.sequence(F.col("fold") - length, F.col("fold") - 1 - purge)).alias("i")).join(months, "i").select("fold", "date")


def expanding_sums(panel: DataFrame, features: list[str], target: str, min_train: int, embargo: int) -> DataFrame:
    """Gram sums of all months before i - embargo, a row a month; its window has no key, over one row a month."""
    sums = gram(panel, features, target, ["i"])
    w = Window.orderBy("i").rangeBetween(Window.unboundedPreceding, -embargo - 1)
    grown = sums.select("i", *[F.sum(c).over(w).alias(c) for c in sums.columns if c != "i"])
    return grown.where(F.col("n").isNotNull() & (F.col("i") >= min_train + embargo))


def expanding_coefficients(panel: DataFrame, features: list[str], target: str, min_train: int, embargo: int, ridge: float = 0.0) -> DataFrame:
    """(i, feature, slope): for every month the least-squares fit on all months before i - embargo. Sums of products
    are made once a month and accumulated, so all folds take one pass over the panel."""
    return solve(expanding_sums(panel, features, target, min_train, embargo), features, ["i"], len(features) + 2, ridge)


def linear_predictions(panel: DataFrame, slopes: DataFrame, features: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., i, date, asset, fwd_ret, pred) of rows whose month has coefficients."""
    wide = slopes.groupBy(*keys, "i").pivot("feature", ["intercept", *features]).agg(F.first("slope"))
    wide = wide.select(*keys, "i", *[F.col(f).alias(f"_b_{f}") for f in ("intercept", *features)])
    pred = F.col("_b_intercept")
    for f in features:
        pred = pred + F.col(f"_b_{f}") * F.coalesce(F.col(f), F.lit(0.0))
    return panel.join(wide, "i").select(*keys, "i", "date", "asset", "fwd_ret", pred.alias("pred"))


def inverses(panel: DataFrame, features: list[str], target: str, min_train: int, embargo: int, alphas: list[float]) -> dict[tuple[int, float], tuple[np.ndarray, np.ndarray]]:
    """{(fold, alpha): (inverse of X'X + alpha, coefficients)} of every month's expanding fit: a small matrix for each month and penalty."""
    grown = expanding_sums(panel, features, target, min_train, embargo).collect()  # one row a month
    k = len(features) + 1
    found = {}
    for r in grown:
        a = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        y = np.array([r[f"y{i}"] for i in range(k)])
        if r["n"] >= k + 1:
            for alpha in alphas:
                inverse = np.linalg.pinv(a + alpha * np.diag([0.0, *[1.0] * (k - 1)]))
                found[r["i"], alpha] = inverse, inverse @ y
    return found


def left_out_errors(panel: DataFrame, features: list[str], target: str, fits: dict, embargo: int) -> DataFrame:
    """(i, alpha, sse, n): squared errors of each fold's training rows, each predicted by the fit without it.

    A ridge fit's error with row x left out is its error over 1 - h, where h = x' A^-1 x and A is the fold's penalised matrix,
    so nothing is fitted again. All folds' matrices go to the tasks (folds times penalties small matrices); a batch of
    rows is met with each of them, and only sums leave the task.
    """
    shared = panel.sparkSession.sparkContext.broadcast(fits)
    rows = panel.where(F.col(target).isNotNull()).select(F.col("i").cast("long").alias("i"), F.col(target).cast("double").alias("_y"), *[F.coalesce(F.col(f), F.lit(0.0)).cast("double").alias(f) for f in features])

    def run(batches):
        sums: dict = {}
        for part in batches:
            x = np.column_stack([np.ones(len(part)), part[features].to_numpy()])
            y, i = part["_y"].to_numpy(), part["i"].to_numpy()
            for (fold, alpha), (inverse, slopes) in shared.value.items():
                train = i < fold - embargo
                if train.any():
                    z = x[train]
                    error = (y[train] - z @ slopes) / np.maximum(1 - ((z @ inverse) * z).sum(axis=1), 1e-12)
                    old = sums.get((fold, alpha), (0.0, 0))
                    sums[fold, alpha] = (old[0] + float(error @ error), old[1] + len(z))
        yield pd.DataFrame([(f, a, e, n) for (f, a), (e, n) in sums.items()], columns=["i", "alpha", "sse", "n"])

    parts = rows.mapInPandas(run, "i long, alpha double, sse double, n long")
    return parts.groupBy("i", "alpha").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))


def ridge_predictions(panel: DataFrame, features: list[str], target: str, min_train: int, embargo: int, alphas: list[float]) -> DataFrame:
    """Predictions of every month by the penalty with the least mean squared error over its training rows, each left out in
    turn (the smallest penalty on ties). The intercept is not penalised."""
    fits = inverses(panel, features, target, min_train, embargo, alphas)
    errors = left_out_errors(panel, features, target, fits, embargo)
    chosen = errors.groupBy("i").agg(F.min_by("alpha", F.struct(F.col("sse") / F.col("n"), "alpha")).alias("alpha"))
    table = [(int(fold), float(alpha), name, float(b)) for (fold, alpha), (_, slopes) in fits.items() for name, b in zip(["intercept", *features], slopes, strict=True)]
    slopes = panel.sparkSession.createDataFrame(table, "i long, alpha double, feature string, slope double")
    best = slopes.join(chosen, ["i", "alpha"])
    alpha = best.select("i", "alpha").distinct()
    return linear_predictions(panel, best.drop("alpha"), features).join(alpha, "i")


def boosted_predictions(
    panel: DataFrame, features: list[str], target: str, first: int, every: int, embargo: int, depth: int = 3, rounds: int = 300, step: float = 0.03, sample: float = 0.8, least: int = 50
) -> tuple[DataFrame, DataFrame]:
    """(fold, date, asset, fwd_ret, pred, n_train, last_train) and (fold, feature, importance) of boosted trees that are
    fitted anew every `every` months from month `first` to the last: fold i learns from the months before i - embargo and
    predicts the months i to i + every - 1; n_train and last_train, the last month learned from, say what it saw.

    Null features become 0 with an indicator beside them. The last tenth of the training months is held back, and rounds
    end when its error rises. The panel is read twice for all folds together; then a pass over a fold's binned rows returns sums by bin (see
    `boosting`), and several folds are submitted side by side, so their small jobs share the cluster. The number of fits is that of the
    folds, whatever the panel's size. Folds without training rows, or without held-back ones, give none.
    """
    session = panel.sparkSession
    rows = panel.select("i", "date", "asset", F.col(target).cast("double").alias("fwd_ret"), *[F.col(f).cast("double").alias(f) for f in features])
    names = [*features, *[f"{f}_null" for f in features]]
    months = {r.i: r.n for r in rows.groupBy("i").agg(F.count("fwd_ret").alias("n")).collect()}  # a row a month
    folds, spans = [], []
    for fold in range(first, max(months) + 1, every) if months else []:
        end = fold - embargo
        past, middle = [i for i, n in months.items() if i < end and n], int(np.ceil(0.9 * end))
        if past and min(past) < middle <= max(past):
            folds.append((fold, sum(months[i] for i in past), max(past)))
            spans.append((middle, end))
    known = rows.where(F.col("fwd_ret").isNotNull()).withColumn("key", F.xxhash64("date", "asset").bitwiseAND(0xFFFFFFFF))
    fits = boost_each(known, features, "fwd_ret", spans, depth, rounds, step, sample, least, 7) if spans else []
    found = []
    for (fold, n, seen), (cuts, trees, weights) in zip(folds, fits, strict=True):
        now = rows.where((F.col("i") >= fold) & (F.col("i") < fold + every))
        one = predicted(now, features, cuts, trees, ["date", "asset", "fwd_ret"])
        one = one.select(F.lit(fold).alias("fold"), "date", "asset", "fwd_ret", "pred", F.lit(n).alias("n_train"), F.lit(seen).alias("last_train"))
        found.append((one, [(fold, name, float(v)) for name, v in zip(names, weights, strict=True)]))
    weights = session.createDataFrame([w for _, each in found for w in each], "fold int, feature string, importance double")
    schema = f"fold int, date {panel.schema['date'].dataType.simpleString()}, asset {panel.schema['asset'].dataType.simpleString()}, fwd_ret double, pred double, n_train long, last_train long"
    preds = reduce(DataFrame.union, [one for one, _ in found]) if found else session.createDataFrame([], schema)
    return preds, weights


def bakeoff(preds: DataFrame, q: float, split: str, base: str, ppy: float = 12.0) -> DataFrame:
    """(model, segment, n, mean_ic, ic_t, ls_sharpe, ls_total, lift) of predictions (model, date, asset, fwd_ret, pred):
    rank ICs and the equal-weight return of the top less the bottom share q of each month, by model before (dev) and from
    `split` on (oos); lift: Sharpe less that of model `base`. Ties are broken by asset."""
    known = preds.where(F.col("pred").isNotNull() & F.col("fwd_ret").isNotNull())
    w = Window.partitionBy("model", "date")
    ranked = known.withColumns({"_t": F.row_number().over(w.orderBy(F.desc("pred"), "asset")), "_b": F.row_number().over(w.orderBy("pred", F.desc("asset"))), "_n": F.count(F.lit(1)).over(w)})
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * q + 1e-9))
    spread = F.avg(F.when(F.col("_t") <= k, F.col("fwd_ret"))) - F.avg(F.when(F.col("_b") <= k, F.col("fwd_ret")))
    months = ranked.groupBy("model", "date").agg(spread.alias("ls")).join(rank_ic(known, "pred", "fwd_ret", 2, ("model", "date")), ["model", "date"], "left")
    s = F.stddev_samp("ls")
    n = F.count("ic")
    parts = segment(months, split).groupBy("model", "segment").agg(
        n.alias("n"),
        F.avg("ic").alias("mean_ic"),
        F.when((n > 1) & (F.stddev_samp("ic") > 0), F.avg("ic") / F.stddev_samp("ic") * F.sqrt(n)).alias("ic_t"),
        F.when(s > 0, F.avg("ls") / s * ppy**0.5).otherwise(0.0).alias("ls_sharpe"),
        (F.product(1 + F.col("ls")) - 1).alias("ls_total"),
    )
    of_base = F.max(F.when(F.col("model") == base, F.col("ls_sharpe"))).over(Window.partitionBy("segment"))
    return parts.withColumn("lift", F.col("ls_sharpe") - of_base)
