"""Cross-validated regressions against closed forms and plain Newton solves, ranks of many configs, and plans without products."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import calibration as C
from citeloom.operators import crossfit as X
from citeloom.operators import metrics as M


@pytest.fixture(scope="module")
def data():
    g = np.random.default_rng(11)
    x = g.random((400, 3)) * [1, 5, 0.1] + [0, 100, 0]
    y = x @ [0.7, -0.2, 3.0] + 0.3 * g.random(400)
    return x, y, (y > np.median(y) + 0.1).astype(int), np.arange(400) % 5


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, label, fold = data
    held = [(*map(float, a), float(b), int(c), int(f)) for a, b, c, f in zip(x, y, label, fold)]
    odd = [(None, 1.0, 1.0, 1.0, 1, 0), (1.0, float("nan"), 1.0, 1.0, 0, 1), (1.0, 1.0, float("inf"), 1.0, 1, 2), (1.0, 1.0, 1.0, None, None, 3), (1.0, 1.0, 1.0, 1.0, 1, None)]
    return spark.createDataFrame(held + odd, "a double, b double, c double, y double, label int, fold int").repartition(4).cache()


def of_folds(models):
    return {r.fold: r for r in models.collect()}


def test_ridge_by_fold(rows, data):
    x, y, _, fold = data
    got = of_folds(X.ridge_by_fold(rows, ["a", "b", "c"], "y", alpha=0.7))
    assert set(got) == {None, 0, 1, 2, 3, 4}
    for f, r in got.items():
        pick = np.ones(400, bool) if f is None else fold != f
        cx, cy = x[pick] - x[pick].mean(0), y[pick] - y[pick].mean()
        w = np.linalg.solve(cx.T @ cx + 0.7 * np.eye(3), cx.T @ cy)
        assert r.n == pick.sum() and np.allclose(r.coefficients, w, atol=1e-7) and r.intercept == pytest.approx(y[pick].mean() - x[pick].mean(0) @ w, abs=1e-5)


def newton(x, y, c, s):
    full, w, pen = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1), np.append(np.ones(x.shape[1]), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-full @ w))
        w = w - np.linalg.solve(c * (full.T * (s * p * (1 - p))) @ full + np.diag(pen), c * full.T @ (s * (p - y)) + pen * w)
    return w


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_by_fold(rows, data, balanced):
    x, _, label, fold = data
    wide = rows.withColumn("b", F.col("b") - 102)
    got = of_folds(X.logistic_by_fold(wide, ["a", "b", "c"], "label", c=0.5, balanced=balanced))
    for f, r in got.items():
        pick = np.ones(400, bool) if f is None else fold != f
        n, pos = pick.sum(), label[pick].sum()
        s = np.where(label[pick] > 0, n / (2 * pos), n / (2 * (n - pos))) if balanced else np.ones(n)
        w = newton(x[pick] - [0, 102, 0], label[pick], 0.5, s)
        assert r.n in (n, n + 1) and np.allclose([*r.coefficients, r.intercept], w, atol=0.05 if r.n > n else 1e-6)


def test_out_of_fold_scores(rows, data):
    x, y, label, fold = data
    known = rows.filter("a is not null and y is not null and not isnan(b) and c < 1000 and fold is not null")
    models = of_folds(X.ridge_by_fold(known, ["a", "b"], "y"))
    report = {r.fold: r for r in X.ridge_report(known, ["a", "b"], "y").collect()}
    for f in range(5):
        pick = fold == f
        p = x[pick][:, :2] @ np.array(models[f].coefficients) + models[f].intercept
        assert report[f].r2 == pytest.approx(1 - ((y[pick] - p) ** 2).sum() / ((y[pick] - y[pick].mean()) ** 2).sum(), abs=1e-6)
        rank = lambda v: np.argsort(np.argsort(v))
        assert report[f].spearman == pytest.approx(np.corrcoef(rank(p), rank(y[pick]))[0, 1], abs=1e-9)
    one = X.summary(X.ridge_report(known, ["a", "b"], "y"), "r2", "spearman").first()
    assert one.r2_mean == pytest.approx(np.mean([r.r2 for r in report.values()])) and one.spearman_std == pytest.approx(np.std([r.spearman for r in report.values()]))
    held = X.held_out(known.filter("fold != 0"), known.filter("fold = 0"), ["a", "c"], "label").first()
    w = newton(x[fold != 0][:, [0, 2]], label[fold != 0], 1.0, np.ones((fold != 0).sum()))
    p, q = (x[m][:, [0, 2]] @ w[:2] + w[2] for m in (fold == 0, fold != 0))
    a, b = p[label[fold == 0] > 0], p[label[fold == 0] == 0]
    assert held.auroc == pytest.approx(np.mean([(u > v) + 0.5 * (u == v) for u in a for v in b]))
    assert (held.accuracy, held.train_accuracy) == pytest.approx((np.mean((p >= 0) == label[fold == 0]), np.mean((q >= 0) == label[fold != 0])))


def test_folds_without_a_model(spark):
    """One class, one fold, or nothing: no model, no prediction, no score; separable data settle thanks to the penalty."""
    df = spark.createDataFrame([(float(i), int(i >= 6), 0 if i < 6 else 1) for i in range(12)], "x double, label int, fold int")
    got = of_folds(X.logistic_by_fold(df, ["x"], "label"))
    assert got[0].coefficients is None and got[1].coefficients is None and got[None].coefficients[0] > 0.5
    assert [r.auroc for r in X.logistic_report(df, ["x"], "label").collect()] == []
    assert of_folds(X.ridge_by_fold(df.filter("fold = 0"), ["x"], "label"))[0].coefficients is None
    none = df.limit(0)
    assert of_folds(X.ridge_by_fold(none, ["x"], "label"))[None].coefficients is None and of_folds(X.logistic_by_fold(none, ["x"], "label"))[None].n == 0
    assert X.ridge_report(none, ["x"], "label").count() == 0


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_no_products_and_null_groups(spark):
    """No metric joins by a product; rows of a null group count as a group."""
    df = spark.range(2_000_000).selectExpr("id", "cast(id % 100003 as double) score", "cast(id % 2 as int) label", "id % 3 g")
    pool = df.selectExpr("id % 5000 query_id", "id ref", "id % 20 rank", "score / 100003 score")
    gold = df.selectExpr("id % 5000 query_id", "id ref").filter("ref % 7 = 0")
    cuts = C.conformal_quantiles(C.calibration_scores(pool, gold, "any"), [0.1, 0.5])
    for x in (M.auroc(df, "score", "label"), M.average_precision(df, "score", "label"), M.spearman(df, "score", "label"), M.auroc(df, "score", "label", ["g"]), cuts, C.conformal_report(pool, gold, gold, cuts)):
        assert "CartesianProduct" not in plan(x)
    few = spark.createDataFrame([(None, 0.1, 0), (None, 0.9, 1), ("a", 0.9, 0), ("a", 0.1, 1)], "g string, score double, label int")
    assert {r.g: r.auroc for r in M.auroc(few, "score", "label", ["g"]).collect()} == {None: 1.0, "a": 0.0}
    assert {r.g: r.spearman for r in M.spearman(few, "score", "label", ["g"]).collect()} == {None: 1.0, "a": -1.0}
    assert {r.g: r.ece for r in M.ece(few, "score", "label", by=["g"]).collect()} == pytest.approx({None: 10.0, "a": 90.0})


def test_grid_of_configs_by_runs(spark):
    """Each config's mean Spearman over folds against plain ranks, with ties, a null target and a constant fold."""
    g = np.random.default_rng(5)
    held = [(int(i), float(g.integers(0, 5)), float(g.integers(0, 5)), float(g.integers(0, 6)), int(i % 3)) for i in range(150)]
    held += [(900, 1.0, 1.0, None, 0), (901, None, 1.0, 2.0, 1)] + [(1000 + i, float(i), 1.0, 3.0, 3) for i in range(4)]
    rows = spark.createDataFrame(held, "id int, a double, b double, y double, fold int")
    configs = spark.createDataFrame([(i, w) for i, w in enumerate((0.0, 0.25, 0.5, 1.0))], "config_id int, w double")
    got = {r.config_id: r.mean_score for r in C.grid_search(rows, configs, F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b"), "y").collect()}

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    for i, w in enumerate((0.0, 0.25, 0.5, 1.0)):
        scores = []
        for f in range(4):
            mine = np.array([(w * a + (1 - w) * b, y) for _, a, b, y, k in held if k == f and y is not None and a is not None])
            x, y = ranks(mine[:, 0]), ranks(mine[:, 1])
            scores.append(np.corrcoef(x, y)[0, 1] if x.std() and y.std() else 0.0)
        assert got[i] == pytest.approx(np.mean(scores))
    runs = C.grid_search(spark.range(1000).selectExpr("id % 7 / 7.0d a", "id % 3 / 3.0d b", "id % 11 / 1.0d y", "id % 2 fold"), configs, F.round(F.col("w") * F.col("a"), 6), "y")
    assert "CartesianProduct" not in plan(runs)
