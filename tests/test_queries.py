"""Every registered query against its SQL form on the smallest tables, and rules that hold for all panels."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from panelspark.operators import blocks as B
from panelspark.operators import calendar as C
from panelspark.operators import clean as P
from panelspark.operators import construct as K
from panelspark.operators import joins as J
from panelspark.operators import ledger as L
from panelspark.operators import stats as E
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.plans import core, events, models, reports, research, technical  # noqa: F401
from panelspark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "-"
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(x)[:10] if hasattr(x, "isoformat") else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


#: Queries without a SQL form, and the test that holds their values against another computation.
HELD = {
    "e01_fama_macbeth": "test_premia_equal_least_squares_by_month",
    "e03_premia_report": "test_premia_equal_least_squares_by_month",
    "m04_combine_ols": "test_linear_models_equal_least_squares",
    "m05_combine_ridge": "test_ridge_query_leaves_each_row_out",
    "m06_combine_gbt": "test_boosted_queries_share_one_walk_forward_fit",
    "m07_bakeoff": "test_boosted_queries_share_one_walk_forward_fit",
    "m08_gbt_importance": "test_boosted_queries_share_one_walk_forward_fit",
    "m09_regime_labels": "test_regime_queries_equal_a_chain_fitted_by_hand",
    "m10_regime_argmax": "test_regime_queries_equal_a_chain_fitted_by_hand",
    "m11_sector_pca": "test_sector_components_equal_a_decomposition",
    "m11_global_factors": "test_sector_components_equal_a_decomposition",
    "m12_model_matrix": "test_model_matrix_is_the_panel_and_the_regimes",
}


def test_every_query_is_held_to_something():
    assert set(QUERIES) - set(ORACLE_SQL) == set(HELD) and all(t in globals() for t in HELD.values())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, base, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()]
    if name in ORACLE_SQL:
        rel = base.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        place = [rel.columns.index(c) for c in columns]
        assert plain(got) == plain([tuple(r[k] for k in place) for r in rel.fetchall()])
    else:
        assert got and len(set(map(str, got))) == len(got)  # values: see HELD


def test_premia_equal_least_squares_by_month(spark):
    import numpy as np

    names = ["mom_z", "low_vol_z", "size_z"]
    months = {}
    for r in core.factor_panel(spark, SF).select("date", "fwd_ret", *names).where("fwd_ret is not null").collect():
        months.setdefault(r.date, []).append([r.fwd_ret, 1.0, *[0.0 if r[n] is None else r[n] for n in names]])
    want = {}
    for d, rows in months.items():
        if len(rows) >= 8:
            v = np.array(rows)
            want[d] = np.linalg.lstsq(v[:, 1:].T @ v[:, 1:], v[:, 1:].T @ v[:, 0], rcond=None)[0]
    got = {}
    for r in QUERIES["e01_fama_macbeth"](spark, SF).collect():
        got.setdefault(r.date, {})[r.feature] = r.slope
    assert got.keys() == want.keys() and len(want) > 50
    for d in want:
        assert np.allclose([got[d][n] for n in ("intercept", *names)], want[d], atol=1e-7)
    report = {(r.feature, r.segment): r for r in QUERIES["e03_premia_report"](spark, SF).collect()}
    assert len(report) == 12
    for k, n in enumerate(("intercept", *names)):
        for seg in ("dev", "oos", "FULL"):
            s = np.array([want[d][k] for d in sorted(want) if seg == "FULL" or (str(d) < research.SPLIT) == (seg == "dev")])
            e = s - s.mean()
            v = e @ e + sum(2 * (1 - j / 4) * (e[j:] @ e[:-j]) for j in (1, 2, 3))
            assert np.isclose(report[n, seg].premium, 12 * s.mean(), atol=1e-7) and report[n, seg].n == len(s)
            assert report[n, seg].t is None if v <= 0 else np.isclose(report[n, seg].t, s.mean() * len(s) / v**0.5, rtol=1e-4)


def test_ridge_query_leaves_each_row_out(spark):
    import numpy as np

    features, alphas = models.FEATURES, [0.1, 1.0, 10.0, 100.0, 1000.0]
    rows = core.factor_panel(spark, SF).select("i", "date", "asset", "fwd_ret", *features).collect()
    got = {(r.date, r.asset): r for r in QUERIES["m05_combine_ridge"](spark, SF).collect()}
    x = np.array([[1.0, *[0.0 if r[f] is None else r[f] for f in features]] for r in rows])
    i, y = np.array([r.i for r in rows]), np.array([np.nan if r.fwd_ret is None else r.fwd_ret for r in rows])
    penalty = np.diag([0.0, *[1.0] * len(features)])
    months = sorted({r.i for r in rows if (r.date, r.asset) in got})
    for m in (months[0], months[-1]):
        train = np.flatnonzero((i < m - 1) & ~np.isnan(y))
        fit = lambda t, a: np.linalg.solve(x[t].T @ x[t] + a * penalty, x[t].T @ y[t])
        errors = [np.mean([(y[r] - x[r] @ fit(train[train != r], a)) ** 2 for r in train]) for a in alphas]
        best = alphas[int(np.argmin(errors))]
        for k, r in enumerate(rows):
            if r.i == m:
                assert got[r.date, r.asset].alpha == best and np.isclose(got[r.date, r.asset].pred, x[k] @ fit(train, best), atol=1e-7)


def test_boosted_queries_share_one_walk_forward_fit(spark):
    preds = QUERIES["m06_combine_gbt"](spark, SF).collect()
    i = {r.date: r.i for r in models.boosted(spark, SF)[0].select("date", "i").distinct().collect()}
    assert {i[r.date] for r in preds} == set(range(37, max(i.values()) + 1))  # all months are served
    assert all(r.fold <= i[r.date] < r.fold + 12 and r.last_train < r.fold - 1 for r in preds)
    importance = {}
    for r in QUERIES["m08_gbt_importance"](spark, SF).collect():
        importance.setdefault(r.fold, {})[r.feature] = r.importance
    assert importance.keys() == {r.fold for r in preds} and all(len(v) == 2 * (len(models.COLUMNS) + 3) and abs(sum(v.values()) - 1) < 1e-6 for v in importance.values())
    found = {(r.model, r.segment): r for r in QUERIES["m07_bakeoff"](spark, SF).collect()}
    assert set(found) == {(m, s) for m in ("ew", "ols", "ridge", "boosted") for s in ("dev", "oos")}
    assert all(r.lift == 0 for (m, _), r in found.items() if m == "ew")
    # The evaluation of these predictions by DuckDB, as in m07_bakeoff_eval.
    rows = [("boosted", r.date, r.asset, r.fwd_ret, r.pred) for r in models.boosted(spark, SF)[1].collect()]
    import pandas as pd

    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["model", "date", "asset", "fwd_ret", "pred"]))
    con.execute("create view typed as select * replace (cast(date as date) as date) from given")
    parts = models.q_bakeoff("select * from typed")
    want = {r[1]: r for r in con.sql("with " + ", ".join(f"{k} as ({v})" for k, v in parts.items()) + " select model, segment, n, round(mean_ic, 6), round(ls_sharpe, 6) from parts").fetchall()}
    for seg in ("dev", "oos"):
        r = found["boosted", seg]
        assert r.n == want[seg][2] and abs(r.mean_ic - want[seg][3]) < 2e-6 and abs(r.ls_sharpe - want[seg][4]) < 1e-4


def test_regime_queries_equal_a_chain_fitted_by_hand(spark):
    import numpy as np

    from panelspark.operators import regimes as RG

    rows = [r for r in models.sector_rows(spark, SF).collect() if r.ret is not None and r.vol is not None]
    got = {(r.sector, r.date): r for r in QUERIES["m09_regime_labels"](spark, SF).collect()}
    named = {(r.sector, r.date): r for r in QUERIES["m10_regime_argmax"](spark, SF).collect()}
    assert got.keys() == named.keys() and got
    for sector in sorted({s for s, _ in got})[:2]:
        mine = sorted((r.i, r.date, r.ret, r.vol) for r in rows if r.sector == sector)
        for fold in (36, 60):
            x, past = np.array([m[2:] for m in mine if m[0] < fold + 12]), np.array([m[0] < fold for m in mine if m[0] < fold + 12])
            x = (x - x[past].mean(axis=0)) / x[past].std(axis=0)
            c = RG.fit_chain(x[past], 3)
            logs = RG.densities(x, c["means"], c["covs"])
            state = None
            for t, m in enumerate(m for m in mine if m[0] < fold + 12):
                state = (c["start"] if state is None else state @ c["moves"]) * np.exp(logs[t] - logs[t].max())
                state /= state.sum()
                if m[0] >= fold:
                    r = got[sector, m[1]]
                    assert np.allclose([r.p_bear, r.p_side, r.p_bull], state, atol=1e-6) and r.fold == fold
                    assert named[sector, m[1]].label == ("bear", "side", "bull")[int(np.argmax(state))]


def test_sector_components_equal_a_decomposition(spark):
    import numpy as np

    sector = {r.asset: r.sector for r in models.fx.sector_of(spark, SF).collect()}
    held = {}
    for r in core.ret_m(spark, SF).where("ret is not null and i >= 1").collect():
        held.setdefault(r.asset, {})[r.i - 1] = min(max(r.ret, -0.15), 0.15)
    n = 1 + max(max(v) for v in held.values())
    share = {(r.sector, r.component): r.explained for r in QUERIES["m11_sector_pca"](spark, SF).collect()}
    for s in sorted(set(sector.values())):
        x = np.full((n, sum(1 for a in held if sector[a] == s)), np.nan)
        for k, a in enumerate(sorted(a for a in held if sector[a] == s)):
            for i, v in held[a].items():
                x[i, k] = v
        x = np.nan_to_num((x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0))
        sv = np.linalg.svd(x, compute_uv=False) ** 2
        want = np.concatenate([sv / sv.sum(), np.zeros(3)])[:3]
        assert np.allclose([share[str(s), j] for j in range(3)], want, atol=1e-9)
    factors = np.array([[r[f"gf_{j}"] for j in range(1, 5)] for r in sorted(QUERIES["m11_global_factors"](spark, SF).collect(), key=lambda r: r.i)])
    assert len(factors) == n and np.allclose(np.cov(factors.T) - np.diag(np.diag(np.cov(factors.T))), 0, atol=1e-8)
    var = factors.var(axis=0)
    assert np.allclose([share["all", j] for j in range(4)], var / var.sum() * sum(share["all", j] for j in range(4)), atol=1e-9)


def test_model_matrix_is_the_panel_and_the_regimes(spark):
    rows = {(r.asset, r.date): r for r in QUERIES["m12_model_matrix"](spark, SF).collect()}
    panel = QUERIES["m12_feature_panel"](spark, SF).collect()
    assert len(rows) == len(panel)
    same = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 2e-6 * max(1, abs(a)))
    assert all(same(rows[r.asset, r.date][c], r[c]) for r in panel for c in models.COLUMNS)
    sector = {r.asset: r.sector for r in models.fx.sector_of(spark, SF).collect()}
    regimes = {(r.sector, r.date): (r.p_bear, r.p_side, r.p_bull) for r in QUERIES["m09_regime_labels"](spark, SF).collect()}
    for (a, d), r in rows.items():
        assert all(abs(x - y) < 1e-9 for x, y in zip((r.regime_0, r.regime_1, r.regime_2), regimes.get((sector[a], d), (0, 0, 0)), strict=True))


def test_linear_models_equal_least_squares(spark):
    """The three-feature fits, month by month, against numpy on the same rows."""
    import numpy as np

    features = models.FEATURES
    rows = core.factor_panel(spark, SF).select("i", "date", "asset", "fwd_ret", *features).collect()
    pred = {(r.date, r.asset): r.pred for r in QUERIES["m04_combine_ols"](spark, SF).collect()}
    x = np.array([[1.0, *[0.0 if r[f] is None else r[f] for f in features]] for r in rows])
    i, y = np.array([r.i for r in rows]), np.array([np.nan if r.fwd_ret is None else r.fwd_ret for r in rows])
    months = sorted({r.i for r in rows if (r.date, r.asset) in pred})
    assert len(months) > 20
    for m in (months[0], months[len(months) // 2], months[-1]):
        train = (i < m - 1) & ~np.isnan(y)
        beta = np.linalg.lstsq(x[train], y[train], rcond=None)[0]
        mine = [k for k, r in enumerate(rows) if r.i == m and pred.get((r.date, r.asset)) is not None]
        assert mine and np.allclose([pred[rows[k].date, rows[k].asset] for k in mine], x[mine] @ beta, atol=1e-6)


def panel(spark, n=40, assets=12):
    rows = [(a, f"2020-01-{1 + k:02d}" if k < 31 else f"2020-02-{k - 30:02d}", 100.0 + 7 * a + ((a * 37 + k * k * 11) % 23) * 0.5, 10.0 + (a * k) % 7) for a in range(assets) for k in range(n)]
    return spark.createDataFrame(rows, "asset long, date string, close double, volume double").withColumn("date", F.to_date("date"))


def test_features_do_not_look_ahead(spark):
    def features(p):
        d = C.densify(p).withColumn("ret", W.simple_return())
        d = d.withColumns({"mom": W.momentum(1, 6), "vol": W.realized_vol(F.col("ret"), 6, 252), "past": W.past_vol(F.col("ret"), 6, 252, 0.01), "beta": W.rolling_ols("ret", "volume", 10, 5)["beta"], "rank": W.pctile_rank("ret", 8, 4), "t": W.trend_signal([2, 5])})
        return {(r.asset, r.i): tuple(r)[3:] for r in d.where("i <= 20").collect()}

    p = panel(spark)
    changed = p.withColumn("close", F.when(F.col("date") > "2020-01-21", F.col("close") * 3 + 1).otherwise(F.col("close")))
    assert features(p) == features(changed)


def test_books_sum_and_ranks_ignore_scale(spark):
    p = panel(spark).withColumn("score", F.col("close") % 13)
    book = {(r.date, r.asset): r.w for r in K.long_short(p, "score").collect()}
    scaled = {(r.date, r.asset): r.w for r in K.long_short(p.withColumn("score", 5 * F.col("score") + 2).repartition(7), "score").collect()}
    assert book == scaled
    by_date = {}
    for (d, _), w in book.items():
        by_date.setdefault(d, []).append(w)
    assert all(abs(sum(w)) < 1e-9 and abs(sum(map(abs, w)) - 2) < 1e-9 for w in by_date.values())


def test_ledger_recursion(spark):
    p = C.densify(panel(spark))
    fwd = C.forward_price(p, 1).withColumn("fwd_ret", F.col("fwd_close") / F.col("close") - 1)
    rows = sorted(L.portfolio_ledger(K.long_short(p.withColumn("s", F.col("close") % 13), "s"), fwd, F.lit(21), 0.001, 0.01).collect(), key=lambda r: r.date)
    capital = 1e6
    for r in rows:
        capital *= (1 - r.turnover * 0.001) * (1 + r.period_return)
        assert abs(r.capital / capital - 1) < 1e-9


def test_quintile_sizes(spark):
    for n, want in ((5, 1), (9, 1), (10, 2), (15, 3), (100, 20)):
        df = spark.range(n).select(F.lit("2020-01-01").alias("date"), F.col("id").alias("asset"), F.col("id").cast("double").alias("s"))
        assert K.long_short(df, "s", least=1).where("w > 0").count() == want


def test_degenerate_zscore_and_clip(spark):
    df = spark.createDataFrame([("d", k, 1.0) for k in range(6)] + [("e", 1, None), ("e", 2, 5.0)], "date string, asset int, v double")
    assert {r.z for r in df.select(X.zscore("v").alias("z")).collect()} == {0.0}
    from panelspark.functions.columns import clip, safe_div

    assert [r[0] for r in df.where("date = 'e'").orderBy("asset").select(clip(F.col("v"), 0.0, 2.0)).collect()] == [None, 2.0]
    assert df.where("asset = 2").select(safe_div(F.col("v"), F.lit(0.0))).first()[0] is None


def test_asof_is_inclusive_and_strict_on_request(spark):
    left = spark.createDataFrame([(1, "2020-01-05"), (1, "2020-01-06"), (2, "2020-01-05")], "asset int, date string").withColumn("date", F.to_date("date"))
    right = spark.createDataFrame([(1, "2020-01-05", 5), (1, "2020-01-01", 1), (2, "2020-01-07", 7)], "asset int, date string, v int").withColumn("date", F.to_date("date"))
    take = lambda **k: sorted((r.asset, str(r.date), r.v) for r in J.asof_join(left, right, ["asset"], "date", ["v"], **k).collect())
    assert take() == [(1, "2020-01-05", 5), (1, "2020-01-06", 5), (2, "2020-01-05", None)]
    assert take(strict=True) == [(1, "2020-01-05", 1), (1, "2020-01-06", 5), (2, "2020-01-05", None)]
    assert take(direction="forward") == [(1, "2020-01-05", 5), (1, "2020-01-06", None), (2, "2020-01-05", 7)]


def test_bounded_fill(spark):
    df = spark.createDataFrame([(1, k, 1.0 if k == 0 else None) for k in range(5)], "asset int, i int, close double")
    assert [r.close for r in P.ffill_limit(df, 2).orderBy("i").collect()] == [1.0, 1.0, 1.0, None, None]


def test_pair_positions_latch(spark):
    z = [0.0, 2.1, 1.0, 0.4, -2.5, None, -2.2, -3.6, -2.5]
    df = spark.createDataFrame([(0, 1, 2, k, x) for k, x in enumerate(z)], "k int, a int, b int, i long, z double")
    assert [r.pos for r in E.pair_positions(df, 2.0, 0.5, 3.5).orderBy("i").collect()] == [0, -1, -1, 0, 1, 0, 1, 0, 0]


def test_pairs_are_found_traded_and_charged(spark):
    """A planted pair over two windows against a plain loop."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = 24 + 2 * 12
    y = np.cumsum(rng.normal(0, 0.05, n)) + 5
    s = np.zeros(n)
    for t in range(1, n):
        s[t] = 0.5 * s[t - 1] + rng.normal(0, 0.03)
    logs = {1: 0.5 + 0.9 * y + s, 2: y, 3: 4 + np.linspace(0, 2, n) + np.cumsum(rng.normal(0, 0.2, n))}
    rows = [(a, t, float(v[t]), float(np.exp(v[t + 1] - v[t]) - 1) if t + 1 < n else None) for a, v in logs.items() for t in range(n)]
    panel = E.window_rows(spark.createDataFrame(rows, "asset int, i int, logp double, nxt double"), 24, 12)
    assert {(r.k, r.n) for r in panel.where("asset = 1").groupBy("k").agg(F.count("*").alias("n")).collect()} == {(0, 36), (1, 36)}
    groups = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "asset int, sector int")
    fit = B.pair_fit(panel.where("not trade"), groups, 24, 0.2, 0.0)
    chosen = E.chosen_pairs(fit, E.residuals(fit, panel.where("not trade")), -1.5, 0.1, 63, 20)
    found = {(r.k, r.a, r.b): r for r in chosen.collect()}
    assert any(key[1:] == (1, 2) for key in found)
    z = E.spread_zscores(chosen, panel.where("trade")).where("i < k * 12 + 35")
    got = {(r.k, r.a, r.b, r.i): r.ret for r in E.pair_returns(E.pair_positions(z, 1.0, 0.5, 3.5, carry=("leg",)), 0.001).collect()}
    for (k, a, b), p in found.items():
        pos, dead = 0, False
        for t in range(12 * k + 24, 12 * k + 35):
            v = (logs[a][t] - p.alpha - p.beta * logs[b][t] - p.mu) / p.sigma
            new = pos
            if dead:
                new = 0
            elif pos == 0:
                new = -1 if v > 1 else 1 if v < -1 else 0
            elif abs(v) < 0.5:
                new = 0
            elif abs(v) > 3.5:
                new, dead = 0, True
            leg = (np.expm1(logs[a][t + 1] - logs[a][t]) - p.beta * np.expm1(logs[b][t + 1] - logs[b][t])) / (1 + p.beta)
            assert abs(got[k, a, b, t] - (new * leg - 0.001 * abs(new - pos))) < 1e-9
            pos = new


def test_ledger_statistics_read_one_panel(spark, monkeypatch):
    """lines are aggregated to the panel once, not for the book, its benchmark and its ICs each."""
    made = []
    one = core.fx.px_m
    monkeypatch.setattr(core.fx, "px_m", lambda *a: made.append(a) or one(*a))
    QUERIES["a12_ledger_perf"](spark, SF)
    assert len(made) == 1


def test_model_matrix_reads_one_panel(spark, monkeypatch):
    """factors, features and regimes read one panel of returns and one table of facts."""
    made = []
    panel, facts = core.fx.px_m, core.fx.facts
    monkeypatch.setattr(core.fx, "px_m", lambda *a: made.append("panel") or panel(*a))
    monkeypatch.setattr(core.fx, "facts", lambda *a: made.append("facts") or facts(*a))
    models.model_matrix(spark, SF)
    assert sorted(made) == ["facts", "panel"]
