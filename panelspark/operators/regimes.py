"""Regimes of return series: chains of hidden states, fitted on the past and filtered forward."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least variance of a state's standardised values, and least weight of a transition.
FLOOR, LEAST_WEIGHT = 1e-3, 1e-3


def densities(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """(rows, states): logarithms of the normal densities of each state."""
    out = np.empty((len(x), len(means)))
    for j, (m, c) in enumerate(zip(means, covs, strict=True)):
        d = x - m
        out[:, j] = -0.5 * ((d @ np.linalg.inv(c)) * d).sum(axis=1) - 0.5 * np.linalg.slogdet(2 * np.pi * c)[1]
    return out


def filtered(log_density: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, float]:
    """Probabilities of the states at each row given the rows up to it, and the log likelihood of all rows."""
    top = log_density.max(axis=1)
    b = np.exp(log_density - top[:, None])
    out, total, state = np.empty_like(b), float(top.sum()), start
    for t in range(len(b)):
        now = b[t] * (state if t == 0 else state @ moves)
        s = now.sum()
        state = out[t] = now / s
        total += float(np.log(s))
    return out, total


def fit_chain(x: np.ndarray, k: int, rounds: int = 200, gain: float = 1e-6) -> dict[str, np.ndarray]:
    """Start, moves, means and covariances of k states of rows x by expectation and maximisation, ordered by the mean of
    the first column. The rows begin in k equal parts by that column, so equal rows give an equal fit."""
    parts = np.array_split(np.argsort(x[:, 0], kind="stable"), k)
    floor = FLOOR * np.eye(x.shape[1])
    means = np.array([x[p].mean(axis=0) for p in parts])
    covs = np.array([np.cov(x.T, bias=True).reshape(floor.shape) + floor] * k)
    start, moves = np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1)) + (0.9 - 0.1 / max(1, k - 1)) * np.eye(k)
    last = -np.inf
    for _ in range(rounds):
        logs = densities(x, means, covs)
        ahead, total = filtered(logs, start, moves)
        if total - last < gain * len(x):
            break
        last = total
        b = np.exp(logs - logs.max(axis=1)[:, None])
        behind, both = np.ones(k), np.zeros((k, k))
        weight = np.empty_like(ahead)
        weight[-1] = ahead[-1]
        for t in range(len(x) - 2, -1, -1):
            seen = b[t + 1] * behind
            pair = ahead[t][:, None] * moves * seen[None, :]
            both += pair / pair.sum()
            behind = moves @ seen
            behind /= behind.sum()
            weight[t] = ahead[t] * behind / (ahead[t] @ behind)
        start = weight[0]
        moves = both + LEAST_WEIGHT
        moves /= moves.sum(axis=1)[:, None]
        share = weight.sum(axis=0) + 1e-12
        means = (weight.T @ x) / share[:, None]
        covs = np.array([((x - m).T * w) @ (x - m) / s + floor for m, w, s in zip(means, weight.T, share, strict=True)])
    order = np.argsort(means[:, 0], kind="stable")
    return {"start": start[order], "moves": moves[np.ix_(order, order)], "means": means[order], "covs": covs[order]}


def walk_forward_regimes(df: DataFrame, values: list[str], by: list[str], k: int, first: int, every: int, purge: int = 0, least: int = 12) -> DataFrame:
    """(by..., fold, i, date, probs, regime) of the rows i >= first of each series: probs are those of k states
    given the series up to the row, by a chain that was fitted on the rows before fold - purge alone, where fold is the
    last of first, first + every, ... that is not after i. States are ordered by the mean of the first value; regime is
    the likeliest, from 0.

    Rows meet the folds that learn from them by arithmetic; each fold of each series is a task's small group (a row a
    date), which is standardised by its training rows, fitted there and filtered forward. Rows without a value are left out;
    folds with fewer than `least` rows to learn from give none. A chain has no closed form, so nothing is summed ahead.
    """
    known = df.where(" and ".join(f"{v} is not null" for v in values))
    own = F.lit(first) + every * F.floor((F.col("i") - first) / every)
    last = known.agg((F.lit(first) + every * F.floor((F.max("i") - first) / every)).alias("_last"))  # one row
    low = F.greatest(F.lit(first), own)
    each = known.join(F.broadcast(last)).withColumn("fold", F.explode(F.when(low <= F.col("_last"), F.sequence(low, F.col("_last"), F.lit(every).cast("long")))))
    each = each.select(*by, F.col("fold").cast("long").alias("fold"), F.col("i").cast("long").alias("i"), "date", *[F.col(v).cast("double").alias(v) for v in values])
    schema = T.StructType([*[each.schema[b] for b in by], *[each.schema[c] for c in ("fold", "i", "date")], T.StructField("probs", T.ArrayType(T.DoubleType()))])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i", kind="stable")
        fold = int(rows["fold"].iloc[0])
        x, past = rows[values].to_numpy(), (rows["i"] < fold - purge).to_numpy()
        test = rows[rows["i"] >= fold]
        if past.sum() < max(least, k) or not len(test):
            return rows.iloc[:0][[*by, "fold", "i", "date"]].assign(probs=[])
        spread = x[past].std(axis=0)
        x = (x - x[past].mean(axis=0)) / np.where(spread > 0, spread, 1.0)
        chain = fit_chain(x[past], k)
        probs = filtered(densities(x, chain["means"], chain["covs"]), chain["start"], chain["moves"])[0]
        return test[[*by, "fold", "i", "date"]].assign(probs=list(probs[(rows["i"] >= fold).to_numpy()]))

    found = each.groupBy(*by, "fold").applyInPandas(run, schema)
    return found.withColumn("regime", F.array_position("probs", F.array_max("probs")).cast("int") - 1)
