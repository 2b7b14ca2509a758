"""Scans, selections, blocked products and chains against plain numpy, over many partitions and blocks."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.columns import correlation
from panelspark.operators import blocks as B
from panelspark.operators import joins as J
from panelspark.operators import ml as M
from panelspark.operators import recurrence as RC
from panelspark.operators import regimes as RG
from panelspark.operators import selection as S
from panelspark.operators import stats as E


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    k, x = 3, rng.normal(size=(6, 2))
    start, moves = np.array([0.5, 0.3, 0.2]), rng.dirichlet(np.ones(k), size=k)
    means, covs = rng.normal(size=(k, 2)), np.array([np.eye(2) * s for s in (0.5, 1.0, 2.0)])
    logs = RG.densities(x, means, covs)
    got, total = RG.filtered(logs, start, moves)
    for t in range(len(x)):
        weight = np.zeros(k)
        for path in itertools.product(range(k), repeat=t + 1):
            p = start[path[0]] * np.prod([moves[a, b] for a, b in itertools.pairwise(path)])
            weight[path[-1]] += p * np.exp(sum(logs[u, s] for u, s in enumerate(path)))
        assert np.allclose(got[t], weight / weight.sum())
    assert np.isclose(total, np.log(weight.sum()))


def test_fit_finds_planted_states_and_never_loses_likelihood():
    rng = np.random.default_rng(2)
    state, x, truth = 0, [], []
    for _ in range(600):
        state = state if rng.random() < 0.95 else int(rng.integers(3))
        x.append([(-2.0, 0.0, 2.5)[state] + rng.normal() * 0.4, (2.0, 0.0, -1.0)[state] + rng.normal() * 0.4])
        truth.append(state)
    x = np.array(x)
    chain = RG.fit_chain(x, 3)
    probs = RG.filtered(RG.densities(x, chain["means"], chain["covs"]), chain["start"], chain["moves"])[0]
    assert (probs.argmax(axis=1) == truth).mean() > 0.97 and np.allclose(chain["means"][:, 0], [-2, 0, 2.5], atol=0.2)
    totals = [RG.filtered(RG.densities(x, c["means"], c["covs"]), c["start"], c["moves"])[1] for c in (RG.fit_chain(x, 3, n) for n in (1, 2, 4, 8, 30))]
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(totals))


def series(spark, n=70, names=("a", "b")):
    rng = np.random.default_rng(3)
    rows = [(s, i, f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", float(rng.normal()) * (1 + (i // 15) % 2), float(rng.random()) + (i // 15) % 2) for s in names for i in range(n)]
    return spark.createDataFrame(rows, "sector string, i int, date string, ret double, vol double")


def test_regimes_do_not_look_ahead(spark):
    def labels(df):
        got = RG.walk_forward_regimes(df, ["ret", "vol"], ["sector"], 3, 30, 10).collect()
        return {(r.sector, r.i): (r.fold, r.regime, tuple(r.probs)) for r in got}

    df = series(spark)
    every = labels(df)
    assert len(every) == 80 and {f for f, _, _ in every.values()} == {30, 40, 50, 60}
    for cut in (35, 52):
        changed = df.withColumns({c: F.when(F.col("i") > cut, F.col(c) * -3 + 1).otherwise(F.col(c)) for c in ("ret", "vol")})
        other, short = labels(changed), labels(df.where(F.col("i") <= cut))
        past = {k: v for k, v in every.items() if k[1] <= cut}
        assert past == {k: v for k, v in other.items() if k[1] <= cut} == short
    assert labels(df.withColumn("ret", F.when(F.col("sector") == "a", F.col("ret")))).keys() == {k for k in every if k[0] == "a"}
    assert labels(df.limit(0)) == {}


@pytest.mark.parametrize("by", [["g"], []])
def test_exact_quantiles_over_ranges(spark, by):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("x", 3001), ("y", 1), ("z", 200)) for v in np.round(rng.normal(size=n), 2)] + [("t", 7.0)] * 500 + [("n", None), (None, 1.0), (None, 3.0)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    levels = [0.0, 0.01, 0.333, 0.5, 0.95, 1.0]
    found = S.exact_quantiles(df, "v", by, levels)
    assert "percentile" not in plan_of(found)
    got = {(r.g if by else "", r.level): r.value for r in found.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g if by else "", []).append(v)
    want = {(g, q): np.quantile(v, q) for g, v in groups.items() for q in levels}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_affine_scan_over_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(s, i, float(rng.normal()) if rng.random() > 0.1 else None) for s, n in (("a", 900), ("b", 3), (None, 40)) for i in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    df = spark.createDataFrame(rows, "s string, i int, r double").repartition(6)
    found = RC.affine_scan(df, ["s"], ["i"], {"x": (F.lit(0.9), F.col("r")), "k": (F.lit(1.0), F.lit(1.0))}, 2.0)
    assert "collect_list" not in plan_of(found)
    got = {(r.s, r.i): (r.x, r.k) for r in found.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for s in ("a", "b", None):
        x, k = 2.0, 2.0
        for _, i, r in sorted((row for row in rows if row[0] == s), key=lambda row: row[1]):
            assert np.isclose(got[s, i][0], x) and got[s, i][1] == k
            x, k = (x if r is None else 0.9 * x + r), k + 1
    assert RC.affine_scan(df.limit(0), [], ["i"], {"x": (F.lit(1.0), F.lit(1.0))}).count() == 0


def test_blocked_products_equal_all_correlations(spark):
    rng = np.random.default_rng(6)
    common = rng.normal(size=(3, 24))
    x = np.array([common[a % 3] * (a % 5) + rng.normal(size=24) for a in range(90)])
    rows = [(0, a, i, float(x[a, i])) for a in range(90) for i in range(24) if not (a == 7 and i == 3)] + [(0, 90, i, 1.0) for i in range(24)]
    df = spark.createDataFrame(rows, "k int, asset int, i int, logp double")
    groups = spark.createDataFrame([(a, a % 2) for a in range(91)], "asset int, sector int")
    vectors = B.unit_vectors(df, ["k", "asset"], "logp", "i", 24)
    assert vectors.count() == 89  # one has a gap, one does not move
    found = B.correlated_pairs(vectors.join(groups, "asset"), ["k", "sector"], "asset", 0.3, size=8)
    got = {(r.a, r.b): r["corr"] for r in found.collect()}
    c = np.corrcoef(x)
    want = {(a, b): c[a, b] for a in range(90) for b in range(a + 1, 90) if a % 2 == b % 2 and 7 not in (a, b) and c[a, b] >= 0.3}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want) and len(want) > 100
    fit = {(r.a, r.b): (r.alpha, r.beta) for r in B.pair_fit(df, groups, 24, 0.3, -99.0).collect()}
    for (a, b), (alpha, beta) in fit.items():
        assert np.allclose(np.polyfit(x[b], x[a], 1), [beta, alpha])
    assert fit.keys() == want.keys()


def test_ridge_leaves_each_row_out(spark):
    rng = np.random.default_rng(7)
    rows = [(i, f"2020-01-{1 + i:02d}", a, *map(float, rng.normal(size=2)), float(rng.normal())) for i in range(14) for a in range(6)]
    rows = [(*r[:5], r[3] * 0.5 + r[5] if r[0] < 13 else None) for r in rows]
    panel = spark.createDataFrame(rows, "i int, date string, asset int, f double, g double, fwd_ret double").repartition(5)
    alphas = [0.1, 10.0, 1000.0]
    got = {(r.i, r.asset): (r.alpha, r.pred) for r in M.ridge_predictions(panel, ["f", "g"], "fwd_ret", 8, 1, alphas).collect()}
    x = np.array([[1.0, r[3], r[4]] for r in rows])
    i, y = np.array([r[0] for r in rows]), np.array([np.nan if r[5] is None else r[5] for r in rows])
    penalty = np.diag([0.0, 1.0, 1.0])
    fit = lambda rows, a: np.linalg.solve(x[rows].T @ x[rows] + a * penalty, x[rows].T @ y[rows])
    for fold in range(9, 13):
        train = np.flatnonzero((i < fold - 1) & ~np.isnan(y))
        errors = [np.mean([(y[r] - x[r] @ fit(train[train != r], a)) ** 2 for r in train]) for a in alphas]
        best = alphas[int(np.argmin(errors))]
        for r in np.flatnonzero(i == fold):
            alpha, pred = got[fold, rows[r][2]]
            assert alpha == best and np.isclose(pred, x[r] @ fit(train, best))
    assert {f for f, _ in got} == set(range(9, 13))  # the last month has nothing to learn or judge by


def test_components_of_groups_equal_a_decomposition(spark):
    rng = np.random.default_rng(8)
    t, rows, data = 40, [], {}
    for g in range(3):
        base = rng.normal(size=(4, t))
        data[g] = [(rng.normal(size=4) @ base + 0.3 * rng.normal(size=t), a) for a in range(12)]
        rows += [(g * 100 + a, g, i, float(v[i])) for v, a in data[g] for i in range(t) if not (a == 3 and i % 7 == 0)]
    df = spark.createDataFrame(rows, "asset int, g int, i int, ret double").repartition(7)
    vectors = B.standard_vectors(df, "asset", "i", "ret", 0, t).join(spark.createDataFrame(sorted({(r[0], r[1]) for r in rows}), "asset int, g int"), "asset").repartition(5)
    shares, scores = B.group_factors(B.gram_rows(vectors, "g", "v", t), "g", 3)
    share = {(r.g, r.component): r.explained for r in shares.collect()}
    score = {(r.g, r.row): r.scores for r in scores.collect()}
    stacked = []
    for g in range(3):
        x = np.array([v for v, _ in data[g]]).T.copy()
        x[::7, 3] = np.nan
        x = np.nan_to_num((x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0))
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        assert np.allclose([share[g, j] for j in range(3)], (s**2 / (s**2).sum())[:3])
        mine = np.array([score[g, i] for i in range(t)])
        assert np.allclose(np.abs(mine), np.abs((u * s)[:, :3]))
        stacked.append(mine)
    found = sorted(B.global_factors(scores, "g", 4, 2).collect(), key=lambda r: r.row)
    factors = np.array([r.factors for r in found])
    assert factors.shape == (t, 2) and abs(np.corrcoef(factors.T)[0, 1]) < 1e-9 and factors[:, 0].std() >= factors[:, 1].std()
    x = np.hstack(stacked)
    load, own = B.factor_analysis((x - x.mean(axis=0)) / x.std(axis=0), 4)
    cov = np.cov(((x - x.mean(axis=0)) / x.std(axis=0)).T, bias=True)
    assert np.allclose(np.diag(load @ load.T) + own, np.diag(cov), atol=1e-3)
    assert np.linalg.norm(cov - load @ load.T - np.diag(own)) < 0.9 * np.linalg.norm(cov - np.diag(np.diag(cov)))


def test_transitions_of_three_states(spark):
    rng = np.random.default_rng(9)
    a, b, dt = np.array([[-1.0, 0.3, 0.0], [0.2, -2.0, 0.5], [0.0, 0.1, -0.5]]), np.array([0.5, -0.2, 0.1]), 0.1
    z, rows, x, y = np.zeros(3), [], [], []
    for _ in range(400):
        n = z + (a @ z + b) * dt + rng.normal(size=3) * np.array([0.3, 0.2, 0.0]) * dt**0.5
        rows.append(("p", *map(float, z), *map(float, n)))
        x.append([1.0, *z])
        y.append(n - z)
        z = n
    df = spark.createDataFrame([*rows, ("p", None, *rows[0][2:]), ("q", *rows[0][1:])], "g string, u double, v double, w double, next_u double, next_v double, next_w double").repartition(4)
    got = {r.target: r for r in E.transition_fit(df, ["u", "v", "w"], ["g"], dt, 12).collect()}
    beta, *_ = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)
    for t, name in enumerate("uvw"):
        left = np.mean((np.array(y)[:, t] - np.array(x) @ beta[:, t]) ** 2) / dt
        assert np.allclose(got[name].drift, beta[1:, t] / dt) and np.isclose(got[name].offset, beta[0, t] / dt) and np.isclose(got[name].sigma2, max(1e-6, left), atol=1e-9)
    assert {r.g for r in got.values()} == {"p"}


def test_bootstrap_draws_where_rows_are(spark):
    rng = np.random.default_rng(10)
    rows = [(g, i, float(v)) for g, m in (("a", 0.0), ("b", 5.0)) for i, v in enumerate(rng.normal(m, 1, 300))] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(4)
    found = E.bootstrap_mean(df, "v", ["g"], "i", 400, 7, 0.95)
    assert "Join" not in plan_of(found)
    for r in found.collect():
        v = np.array([x for g, _, x in rows if g == r.g and x is not None])
        assert abs(r.low - (v.mean() - 1.96 * v.std() / 300**0.5)) < 0.03 and abs(r.high - (v.mean() + 1.96 * v.std() / 300**0.5)) < 0.03
    assert E.DRAWS[0] == np.exp(-1) and all(np.diff(E.DRAWS) > 0)


def test_boosted_trees_learn_from_the_past_alone(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(40):
        for a in range(25):
            f, g = map(float, rng.normal(size=2))
            rows.append((i, f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", a, f, g if a % 5 else None, float(np.sign(f) * 0.3 + rng.normal() * 0.1) if i < 39 else None))
    df = spark.createDataFrame(rows, "i int, date string, asset int, f double, g double, y double")
    preds, weights = M.boosted_predictions(df, ["f", "g"], "y", 24, 8, 2, rounds=12, step=0.3, least=10)
    got = {(r.date, r.asset): r for r in preds.collect()}
    assert len(got) == 16 * 25 and {r.fold for r in got.values()} == {24, 32}
    assert all(r.last_train == r.fold - 3 and r.n_train == 25 * (r.fold - 2) for r in got.values())
    assert np.corrcoef([got[d, a].pred for _, d, a, _, _, y in rows if (d, a) in got and y is not None], [y for _, d, a, _, _, y in rows if (d, a) in got and y is not None])[0, 1] > 0.9
    share = {}
    for r in weights.collect():
        share.setdefault(r.fold, {})[r.feature] = r.importance
    assert all(s["f"] > 0.9 and np.isclose(sum(s.values()), 1) and set(s) == {"f", "g", "f_null", "g_null"} for s in share.values())
    changed, _ = M.boosted_predictions(df.withColumn("y", F.when(F.col("i") >= 22, -F.col("y")).otherwise(F.col("y"))), ["f", "g"], "y", 24, 8, 2, rounds=12, step=0.3, least=10)
    same = [r for r in changed.where("fold = 24").collect()]
    assert len(same) == 200 and all(np.isclose(got[r.date, r.asset].pred, r.pred) for r in same)
    assert M.boosted_predictions(df.limit(0), ["f", "g"], "y", 24, 8, 2)[0].count() == 0


def test_pairs_are_tested_where_they_meet(spark):
    """Fits, tests and choices from blocks equal those over joined spreads; copies of an asset make a spread that does not move."""
    rng = np.random.default_rng(11)
    common = np.cumsum(rng.normal(size=(2, 24)) * 0.1, axis=1)
    x = np.array([3 + common[a % 2] * (1 + a % 3) + rng.normal(size=24) * 0.05 for a in range(40)])
    x = np.concatenate([x, x[:3]])  # assets 40 to 42 are copies
    df = spark.createDataFrame([(0, a, i, float(x[a, i])) for a in range(43) for i in range(24)], "k int, asset int, i int, logp double")
    groups = spark.createDataFrame([(a, 0) for a in range(43)], "asset int, sector int")
    found = B.pair_fit(df, groups, 24, 0.2, -99.0, test=True, size=8)
    assert "Join" not in plan_of(found).split("FlatMapGroups")[0]  # nothing is joined to pairs
    got = {(r.a, r.b): r for r in found.collect()}
    copies = {(0, 40), (1, 41), (2, 42)}
    assert len(got) == found.count() and copies < got.keys() and all(np.isnan(got[c].t) and got[c].half_life is None for c in copies)
    fit = B.pair_fit(df, groups, 24, 0.2, -99.0).where("not (b >= 40 and a = b - 40)")
    spreads = E.residuals(fit, df)
    t = {(r.a, r.b): r.t for r in E.adf_t(spreads).collect()}
    ou = {(r.a, r.b): (r.half_life, r.mu, r.sigma) for r in E.ou_fit(spreads, 0.0, 1e9).collect()}
    assert t.keys() == got.keys() - copies and all(np.isclose(t[p], got[p].t) for p in t) and len(t) > 100
    assert ou.keys() == {p for p, r in got.items() if r.half_life is not None} and all(np.allclose(v, [got[p].half_life, got[p].mu, got[p].sigma], atol=1e-9) for p, v in ou.items())
    # Copies tie in t to the last bit, so ties go by a and b.
    ties = [(p, (p[0] + 40, p[1] + 40)) for p in [(0, 1), (0, 2), (1, 2)] if p in got]
    assert ties and all(got[p].t == got[q].t for p, q in ties)
    few = B.pair_fit(df, groups, 24, 0.2, -99.0, test=True, keep=lambda p: (p["t"] <= -2.0) & p["half_life"].between(0.1, 63), most=5, size=8)
    best = [(r.a, r.b) for r in E.best_pairs(few, -2.0, 0.1, 63, 5).orderBy("t", "a", "b").collect()]
    assert best == [(r.a, r.b) for r in E.best_pairs(found, -2.0, 0.1, 63, 5).orderBy("t", "a", "b").collect()] and len(best) == 5


def test_equal_values_have_no_correlation(spark):
    """Ranks of a date on which all scores are equal, merged from many tasks."""
    df = spark.range(0, 40 * 47 * 16, 1, 16).selectExpr("cast(id % 40 as int) as g", "29910.5 + (id % 40) * 0.1 as x", "cast(hash(id) as double) as y")
    found = df.groupBy("g").agg(correlation(F.col("x"), F.col("y")).alias("c"), correlation(F.col("y"), F.col("y")).alias("one")).collect()
    assert len(found) == 40 and all(r.c is None and np.isclose(r.one, 1) for r in found)


def test_pairs_within_a_group_meet_in_blocks(spark):
    """All pairs once, dealt by blocks: no task has the members of a whole group."""
    df = spark.createDataFrame([(a % 2, a) for a in range(301)], "sector int, asset long")
    found = J.pairs_within(df, "sector", 16)
    got = [(r.sector, r.a, r.b) for r in found.collect()]
    assert sorted(got) == [(s, a, b) for s in (0, 1) for a in range(s, 301, 2) for b in range(a + 2, 301, 2)]
    made = [n for n in found.groupBy(F.spark_partition_id()).count().toPandas()["count"]]
    assert len(made) > 20 and max(made) < len(got) / 8
    assert J.pairs_within(df.limit(0), "sector", 16).count() == 0


def test_lines_of_orders_are_not_sorted(spark):
    """too large for a broadcast, orders go to a hash table and their lines are streamed past it."""
    from panelspark.plans import fixtures as fx

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(fx.purchases(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "ShuffledHashJoin" in plan and "Sort [" not in plan


def test_boosted_trees_take_the_best_splits(spark):
    """one full tree equals a search over all splits; with draws, the fit does not depend on how rows are dealt."""
    from panelspark.operators import boosting as BT

    rng = np.random.default_rng(3)
    n = 1500
    x = rng.integers(0, 12, size=(n, 3)).astype(float) - 4
    gone = rng.random((n, 3)) < [0.0, 0.2, 0.4]
    y = np.where(gone[:, 2], 1.0, 0.0) + np.where(x[:, 0] > 1, 2.0, 0.0) * (x[:, 1] < 3) + 0.1 * rng.normal(size=n)
    rows = [(k, k >= 1200, float(y[k]), *[None if gone[k, j] else float(x[k, j]) for j in range(3)]) for k in range(n)]
    df = spark.createDataFrame(rows, "key long, valid boolean, y double, a double, b double, c double")
    names = ["a", "b", "c"]
    cuts, trees, weights = BT.boost(df, names, "y", 2, 1, 0.1, 1.0, 20, 7)
    filled = np.where(gone, 0.0, x)
    both = np.concatenate([filled, gone.astype(float)], axis=1)

    def search(own):
        best = (0.0, None)
        for j in range(6):
            for cut in np.unique(both[own, j])[:-1]:
                left = own & (both[:, j] <= cut)
                right = own & ~left
                if left.sum() >= 20 and right.sum() >= 20:
                    gain = y[left].sum() ** 2 / left.sum() + y[right].sum() ** 2 / right.sum() - y[own].sum() ** 2 / own.sum()
                    best = max(best, (gain, (j, cut)), key=lambda g: g[0])
        return best

    def walk(own, depth, test):
        gain, split = search(own) if depth else (0.0, None)
        if split is None:
            return np.where(test, y[own].mean(), 0.0), {}
        side = both[:, split[0]] <= split[1]
        (lv, lg), (rv, rg) = walk(own & side, depth - 1, test & side), walk(own & ~side, depth - 1, test & ~side)
        gains = {j: lg.get(j, 0) + rg.get(j, 0) for j in {*lg, *rg}}
        gains[split[0]] = gains.get(split[0], 0) + gain
        return lv + rv, gains

    want, gains = walk(np.arange(n) < 1200, 2, np.ones(n, dtype=bool))
    got = {r.key: r.pred for r in BT.predicted(df, names, cuts, trees, ["key"]).collect()}
    assert np.allclose([got[k] for k in range(n)], want)
    assert np.allclose(weights, [gains.get(j, 0) / sum(gains.values()) for j in range(6)])
    panel = df.select((F.col("key") % 30).cast("int").alias("i"), (F.col("key") % 30).alias("date"), F.col("key").alias("asset"), "y", *names)
    fits = [M.boosted_predictions(p, names, "y", 20, 10, 1, rounds=10, step=0.2, least=10)[0].collect() for p in (panel.repartition(2), panel.repartition(5, "asset"))]
    one, two = ({r.asset: r.pred for r in f} for f in fits)
    assert len(one) == 500 and one.keys() == two.keys() and np.allclose([one[k] for k in one], [two[k] for k in one])


def test_all_folds_read_the_panel_twice(spark):
    """thresholds and blocks of all folds come from one pass each, however many folds there are."""
    rng = np.random.default_rng(5)
    rows = [(i, i, a, float(rng.normal()), float(rng.normal())) for i in range(40) for a in range(10)]
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    panel = spark.createDataFrame(rows, "i int, date int, asset int, x double, y double").withColumn("x", F.udf(seen, "double")("x"))
    preds, _ = M.boosted_predictions(panel, ["x"], "y", 20, 4, 1, rounds=2, least=5)
    assert 0 < read.value <= 2 * len(rows)
    assert preds.select("fold").distinct().count() == 5


def test_one_count_serves_two_features(spark):
    """sums by code from weights that hold a row and its residual, of an odd number of features."""
    from panelspark.operators import boosting as BT

    rng = np.random.default_rng(6)
    codes, rest, keep = rng.integers(0, 33, size=(5, 16384)).astype(np.uint8), rng.normal(size=16384), rng.random(16384) < 0.8
    codes[2], rest[0] = 32, 40.0
    pairs = BT.paired(codes)
    assert all((BT.code_of(pairs, f) == codes[f]).all() for f in range(5))
    got = BT.by_code(pairs, *BT.weighed(rest, keep), 5)
    for f in range(5):
        assert (got[f, :, 0] == np.bincount(codes[f][keep], minlength=33)).all()
        assert np.allclose(got[f, :, 1], np.bincount(codes[f][keep], weights=rest[keep], minlength=33), atol=1e-3)
    tree = ([{1: (4, 20, True)}, {3: (2, 31, False)}], np.arange(8.0))
    right = (codes[4] > 20) & (codes[4] != 32)
    assert (BT.values(pairs, tree) == np.where(right, np.where(codes[2] > 31, 7, 6), 4)).all()


def test_pairs_pass_on_what_is_asked(spark):
    """t and half-life from three sums of products equal a regression's; only the fields asked for leave a task; rounding is SQL's."""
    import duckdb

    from panelspark.functions.columns import nearest

    rng = np.random.default_rng(12)
    for phi in (0.1, 0.6, 0.97):
        s = np.zeros((24, 30))
        for i in range(1, 24):
            s[i] = phi * s[i - 1] + rng.normal(size=30)
        s -= s.mean(axis=0)
        got = B.tested(s, np.zeros(30, bool))
        for j in range(30):
            x, d = s[:, j], np.diff(s[:, j])
            a = np.column_stack([np.ones(22), x[1:-1], d[:-1]])
            b, error = np.linalg.lstsq(a, d[1:], rcond=None)[:2]
            assert np.isclose(got["t"][j], b[1] / np.sqrt(error[0] / 19 * np.linalg.inv(a.T @ a)[1, 1]), rtol=1e-9)
            slope, c = np.polyfit(x[:-1], x[1:], 1)
            if 0 < slope < 1:
                assert np.allclose([got["half_life"][j], got["mu"][j], got["sigma"][j]], [-np.log(2) / np.log(slope), c / (1 - slope), x.std(ddof=1)], rtol=1e-7)
    df = spark.createDataFrame([(0, a, i, float(v)) for a in range(20) for i, v in enumerate(rng.normal(size=24))], "k int, asset int, i int, logp double")
    groups = spark.createDataFrame([(a, 0) for a in range(20)], "asset int, sector int")
    few, whole = (B.pair_fit(df, groups, 24, 0.2, -99.0, test=True, size=8, **more) for more in ({"fields": ("t",)}, {}))
    assert few.columns == ["k", "a", "b", "t"] and {(r.a, r.b, r.t) for r in few.collect()} == {(r.a, r.b, r.t) for r in whole.collect()}
    given = [0.5, -0.5, 2.5, 1.0000005, -0.0000001, 1e300, *map(float, rng.normal(size=2000)), *(k + 0.125 for k in range(-9, 9))]
    got = [r.x for r in spark.createDataFrame([(v,) for v in given], "x double").select(nearest(F.col("x"), 2).alias("x")).collect()]
    want = [r[0] for r in duckdb.connect().execute("select round(x, 2) + 0.0 from (select unnest($1::double[]) as x)", [given]).fetchall()]
    assert got == want and str(got[4]) == "0.0"


def test_rolling_regression_sums_each_column_once(spark):
    """the matrix's widest windows are evaluated once, with the values of rolling_ols."""
    from panelspark.operators import windows as W

    rng = np.random.default_rng(13)
    rows = [(a, i, float(rng.normal()) if (a + i) % 7 else None, 1.0 if a == 4 else float(rng.normal()) if (a + i) % 5 else None) for a in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "asset int, i int, y double, x double")
    once = W.with_rolling_ols(df, "y", "x", 10, 5)
    plan = plan_of(once)
    assert plan.count("covar_samp(") == plan.count("var_samp(") - plan.count("covar_samp(") == 1 and "regr_" not in plan
    fit = W.rolling_ols("y", "x", 10, 5)
    want = {(r.asset, r.i): r for r in df.withColumns(fit).collect()}
    near = lambda p, q: p is q is None or (p is not None and q is not None and np.isclose(p, q, rtol=1e-9, atol=1e-12))
    got = once.collect()
    assert len(got) == 200 and sum(r.beta is not None for r in got) > 100
    assert all(near(r[c], want[r.asset, r.i][c]) for r in got for c in ("alpha", "beta", "resid"))
