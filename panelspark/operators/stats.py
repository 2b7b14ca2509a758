"""Econometrics: regressions from sums, HAC errors, cointegrated pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.columns import correlation


def gram(df: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """Sums of products of (1, features) with each other and with the target, by group; null features count as 0."""
    x = [F.lit(1.0), *[F.coalesce(F.col(f), F.lit(0.0)) for f in features]]
    y = F.col(target)
    k = len(x)
    xx = [F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    return df.where(y.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *xx, *[F.sum(x[i] * y).alias(f"y{i}") for i in range(k)])


def solve(grams: DataFrame, features: list[str], by: list[str], least: int, ridge: float = 0.0) -> DataFrame:
    """(by..., feature, slope) from Gram sums, one small system a group; groups under `least` rows are left out."""
    k = len(features) + 1
    fields = [f for f in grams.schema.fields if f.name in by]

    def run(batches):
        for rows in batches:
            out = []
            for r in rows[rows["n"] >= least].to_dict("records"):
                a = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                a += ridge * np.diag([0.0, *[1.0] * (k - 1)])
                slopes = np.linalg.lstsq(a, np.array([r[f"y{i}"] for i in range(k)]), rcond=None)[0]
                out += [{**{b: r[b] for b in by}, "feature": f, "slope": float(s)} for f, s in zip(["intercept", *features], slopes, strict=True)]
            yield pd.DataFrame(out, columns=[*by, "feature", "slope"])

    return grams.mapInPandas(run, T.StructType([*fields, T.StructField("feature", T.StringType()), T.StructField("slope", T.DoubleType())]))


def newey_west(df: DataFrame, value: str, by: list[str], order: str, lags: int) -> DataFrame:
    """(by..., mean, t, n) with Bartlett weights and no small-sample correction."""
    centred = df.where(F.col(value).isNotNull()).withColumn("_e", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    w = Window.partitionBy(*by).orderBy(order)
    cross = [F.sum(F.col("_e") * F.col(f"_l{k}")) * (2 * (1 - k / (lags + 1))) for k in range(1, lags + 1)]
    lagged = centred.withColumns({f"_l{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    s = F.sum(F.col("_e") * F.col("_e"))
    for c in cross:
        s = s + F.coalesce(c, F.lit(0.0))
    n = F.count(F.lit(1))
    return lagged.groupBy(*by).agg(F.avg(value).alias("mean"), F.when(s > 0, F.avg(value) * n / F.sqrt(s)).alias("t"), n.alias("n"))


#: What names a pair of one walk-forward window.
PAIR = ("k", "a", "b")


def window_rows(panel: DataFrame, formation: int, trading: int) -> DataFrame:
    """Rows of panel (i, ...) for each full window k, formation from row k * trading on, that holds them, with `trade`: whether i lies in its
    trading part. A row meets its windows by arithmetic, at most 1 + formation / trading of them."""
    last = panel.agg((F.max("i") + 1).alias("_n"))  # one row
    low = F.greatest(F.lit(0), F.floor((F.col("i") - formation - trading) / trading) + 1)
    high = F.least(F.floor(F.col("i") / trading), F.floor((F.col("_n") - formation - trading) / trading))
    each = panel.join(F.broadcast(last)).withColumn("k", F.explode(F.when(low <= high, F.sequence(low, high)))).drop("_n")
    return each.withColumn("trade", F.col("i") >= F.col("k") * trading + formation)


def of_pairs(pairs: DataFrame, rows: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """pairs beside the rows (k, asset, i, values...) of a and of b at the same k and i; values by name: the prefix of a's and
    b's columns. `by`: columns of pairs, among them a and b, that name a pair."""
    side = lambda x: rows.select("k", F.col("asset").alias(x), "i", *[F.col(c).alias(f"{p}{x}") for c, p in values.items()])
    return pairs.join(side("a"), [c for c in ("k", "a") if c in by]).join(side("b"), ["k", "b", "i"])


def residuals(fit: DataFrame, logs: DataFrame) -> DataFrame:
    """(k, a, b, i, s): the pair's spread log a - alpha - beta * log b."""
    both = of_pairs(fit, logs, [*PAIR], {"logp": "y"})
    return both.select(*PAIR, "i", (F.col("ya") - F.col("alpha") - F.col("beta") * F.col("yb")).alias("s"))


def spread_steps(spreads: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAIR).orderBy("i")
    d = spreads.withColumn("s1", F.lag("s").over(w)).withColumn("ds", F.col("s") - F.col("s1"))
    return d.withColumn("ds1", F.lag("ds").over(w))


def adf_t(spreads: DataFrame) -> DataFrame:
    """(k, a, b, t): t of the level in the regression of the change on 1, the level and the change before."""
    rows = spread_steps(spreads).where("ds1 is not null")
    n = F.count(F.lit(1))

    def s(x: str, y: str) -> Column:
        return F.covar_pop(x, y) * n

    saa, sbb, sab, say, sby, syy = s("s1", "s1"), s("ds1", "ds1"), s("s1", "ds1"), s("s1", "ds"), s("ds1", "ds"), s("ds", "ds")
    det = saa * sbb - sab * sab
    beta, gamma = (say * sbb - sby * sab) / det, (sby * saa - say * sab) / det
    rss = syy - beta * say - gamma * sby
    return rows.groupBy(*PAIR).agg((beta / F.sqrt(rss / (n - 3) * sbb / det)).alias("t"))


def ou_fit(spreads: DataFrame, low: float, high: float) -> DataFrame:
    """(k, a, b, half_life, mu, sigma) of s on s before, for slopes within (0, 1) and half-lives within [low, high]."""
    rows = spread_steps(spreads)
    fit = rows.groupBy(*PAIR).agg(F.regr_slope("s", "s1").alias("phi"), F.regr_intercept("s", "s1").alias("c"), F.stddev_samp("s").alias("sigma"))
    out = fit.where("phi > 0 and phi < 1").select(*PAIR, (-F.log(F.lit(2.0)) / F.log("phi")).alias("half_life"), (F.col("c") / (1 - F.col("phi"))).alias("mu"), "sigma")
    return out.where(F.col("half_life").between(low, high))


def chosen_pairs(fit: DataFrame, spreads: DataFrame, critical: float, low: float, high: float, most: int) -> DataFrame:
    """fit with t, half_life, mu and sigma: of each window the `most` pairs of least t (ties by a, b) among those of t at
    most `critical` and a half-life within [low, high]."""
    return best_pairs(fit.join(adf_t(spreads), [*PAIR]).join(ou_fit(spreads, low, high), [*PAIR]), critical, low, high, most)


def best_pairs(tested: DataFrame, critical: float, low: float, high: float, most: int) -> DataFrame:
    """chosen_pairs of pairs with their t, half_life, mu and sigma."""
    rows = tested.where((F.col("t") <= critical) & F.col("half_life").between(low, high))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy("t", "a", "b"))).where(F.col("_r") <= most).drop("_r")


def spread_zscores(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs beside (i, z, leg) over the window's trading rows (k, asset, i, logp, nxt): z of the spread with the
    parameters of the formation, and the next step's return of one long spread, weighed 1 : beta to a gross of 1."""
    both = of_pairs(pairs, rows, [*PAIR], {"logp": "y", "nxt": "r"})
    z = (F.col("ya") - F.col("alpha") - F.col("beta") * F.col("yb") - F.col("mu")) / F.col("sigma")
    leg = (F.col("ra") - F.col("beta") * F.col("rb")) / (1 + F.col("beta"))
    return both.withColumns({"z": z, "leg": leg}).drop("ya", "yb", "ra", "rb")


def pair_positions(z: DataFrame, entry: float | str, out: float, stop: float, by: tuple[str, ...] = PAIR, carry: tuple[str, ...] = ()) -> DataFrame:
    """(by..., i, pos, carry...): +1 below -entry, -1 above entry, flat within `out`; a position that meets a z beyond
    `stop` ends, and the pair stays flat. An unknown z is flat. entry: a number or a column of `by`. One fold over each
    pair's rows, which one trading window bounds."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "z", *carry)))
    kept = "".join(f", x.{c} as {c}" for c in carry)
    types = "".join(f", {c}: double" for c in carry)
    step = lambda pos, dead: f"struct(cast({pos} as int) as pos, {dead} as dead, array_append(s.path, struct(x.i as i, cast({pos} as int) as pos{kept})) as path)"
    fold = f"""aggregate(rows, struct(cast(0 as int) as pos, false as dead, cast(array() as array<struct<i: bigint, pos: int{types}>>) as path), (s, x) -> case
        when x.z is null then {step("0", "s.dead")}
        when s.dead then {step("0", "true")}
        when s.pos = 0 and x.z > {entry} then {step("-1", "false")}
        when s.pos = 0 and x.z < -{entry} then {step("1", "false")}
        when s.pos <> 0 and abs(x.z) < {out} then {step("0", "false")}
        when s.pos <> 0 and abs(x.z) > {stop} then {step("0", "true")}
        else {step("s.pos", "false")} end, s -> s.path)"""
    folded = z.groupBy(*by).agg(rows.alias("rows")).select(*by, F.explode(F.expr(fold)).alias("p"))
    return folded.select(*by, "p.*")


def pair_returns(positions: DataFrame, cost: float, by: tuple[str, ...] = PAIR) -> DataFrame:
    """positions (by..., i, pos, leg) with ret: what the position earns to the next row, less cost for each change of it."""
    before = F.coalesce(F.lag("pos").over(Window.partitionBy(*by).orderBy("i")), F.lit(0))
    return positions.withColumn("ret", F.coalesce(F.col("pos") * F.col("leg"), F.lit(0.0)) - cost * F.abs(F.col("pos") - before))


def pairs_book(returns: DataFrame, slots: DataFrame, steps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., k, i, n_open, ret): equal-weight mean over all slots of the window, 0 where no pair is open; rows before
    the first return are left out. slots: (by..., k, n); steps: (by..., k, i), all trading rows."""
    total = returns.groupBy(*by, "k", "i").agg(F.sum("ret").alias("_sum"), F.count(F.when(F.col("pos") != 0, 1)).alias("n_open"))
    rows = steps.join(slots, [*by, "k"], "left").join(total, [*by, "k", "i"], "left")
    rows = rows.select(*by, "k", "i", F.coalesce("n_open", F.lit(0)).alias("n_open"), F.coalesce(F.col("_sum") / F.col("n"), F.lit(0.0)).alias("ret"))
    begun = F.max(F.col("ret") != 0).over(Window.partitionBy(*by).orderBy("i"))
    return rows.withColumn("_begun", begun).where("_begun").drop("_begun")


#: Least uniform numbers at which a row is drawn 1, 2, ... times: sums of the Poisson distribution of mean 1.
DRAWS = [sum(math.exp(-1) / math.factorial(j) for j in range(k)) for k in range(1, 13)]


def bootstrap_mean(df: DataFrame, value: str, by: list[str], order: str, n_boot: int, seed: int, conf: float) -> DataFrame:
    """(by..., low, high): percentile interval of resampled means of each group.

    A row takes part in a sample as often as a Poisson number of mean 1, which the hash of (seed, row, sample) chooses, so
    samples are drawn where rows are, in one pass; a group's sample has its number of rows on average. Weighted sums combine
    before the shuffle: n_boot rows a group and task. `order` and `by` tell rows apart; null values are left out.
    """
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*by, order)])
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), key.alias("_key"))
    each = rows.withColumn("_sample", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    uniform = F.conv(F.substring(F.md5(F.concat_ws(":", "_key", F.col("_sample").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = F.lit(0)
    for least in DRAWS:
        times = times + (F.col("_u") >= least).cast("int")
    drawn = each.withColumn("_u", uniform).withColumn("_w", times).where("_w > 0")
    means = drawn.groupBy(*by, "_sample").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_m"))
    q = F.percentile("_m", F.array(F.lit((1 - conf) / 2), F.lit((1 + conf) / 2)))
    return means.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def transition_fit(steps: DataFrame, states: list[str], by: list[str], dt: float, least: int, floor: float = 1e-6) -> DataFrame:
    """(by..., target, drift, offset, sigma2) of dz = (A z + b) dt + noise for each group's vector state z: `drift` is the
    target's row of A in the order of `states`, `offset` its b, sigma2 its residual variance over dt, floored.

    steps: by, the states, and `next_<state>`. One aggregation has the sums of products of (1, z) with itself and
    with all the changes, and of each change with itself; each group's small system is solved from these. Rows with a
    null are left out, groups of fewer than `least` rows too.
    """
    x = [F.lit(1.0), *map(F.col, states)]
    y = [F.col(f"next_{s}") - F.col(s) for s in states]
    k, d = len(x), len(states)
    sums = [F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(x[i] * y[t]).alias(f"y{i}_{t}") for i in range(k) for t in range(d)] + [F.sum(y[t] * y[t]).alias(f"e{t}") for t in range(d)]
    known = steps.where(" and ".join(f"{c} is not null" for s in states for c in (s, f"next_{s}")))
    grams = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)
    schema = T.StructType([*[grams.schema[b] for b in by], T.StructField("target", T.StringType()), T.StructField("drift", T.ArrayType(T.DoubleType())), T.StructField("offset", T.DoubleType()), T.StructField("sigma2", T.DoubleType())])

    def run(batches):
        for rows in batches:
            out = []
            for r in rows[rows["n"] >= least].to_dict("records"):
                a = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                c = np.array([[r[f"y{i}_{t}"] for t in range(d)] for i in range(k)])
                slopes = np.linalg.lstsq(a, c, rcond=None)[0]
                for t, s in enumerate(states):
                    left = max(0.0, r[f"e{t}"] - float(slopes[:, t] @ c[:, t])) / r["n"]
                    out.append([*[r[b] for b in by], s, slopes[1:, t] / dt, slopes[0, t] / dt, max(floor, left / dt)])
            yield pd.DataFrame(out, columns=[*by, "target", "drift", "offset", "sigma2"])

    return grams.mapInPandas(run, schema)
