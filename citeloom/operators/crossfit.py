"""Cross-validated regressions from sufficient statistics by fold: one pass over the rows fits the models of all folds.

A fold's model is fitted on the rows of all other folds. Ridge regression needs each fold's moments once: the training
moments of a fold are those of the others, merged. Logistic regression adds up gradient, Hessian and loss of all
models in one aggregate for each Newton step. What the driver gets is one row a fold, as wide as the
features squared; no rows are copied into training sets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.metrics import auroc, null_safe_join, spearman

MODELS = "fold int, n long, coefficients array<double>, intercept double"


def _known(rows: DataFrame, features: list[str], y: str, fold: str) -> DataFrame:
    """Features x0.., y and fold as plain columns; rows with a null or non-finite value, or without a fold, fit nothing."""
    cols = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    out = rows.select(*cols, F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("fold")).filter("fold is not null")
    for c in out.columns[:-1]:
        out = out.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out


def _merge(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and centred cross products of several groups taken together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def _frame(rows: DataFrame, models: list[tuple]) -> DataFrame:
    return rows.sparkSession.createDataFrame([(None if f is None else int(f), int(n), None if c is None else [float(v) for v in c], None if b is None else float(b)) for f, n, c, b in models], MODELS)


def ridge_by_fold(rows: DataFrame, features: list[str], target: str, fold: str = "fold", alpha: float = 1.0) -> DataFrame:
    """(fold, n, coefficients, intercept) of each fold's ridge regression on the other folds' n rows, and with a null fold that on all rows.

    Penalty alpha on the squared coefficients, none on the intercept. A fold with no other rows has no model (nulls).
    """
    known = _known(rows, features, target, fold)
    names = [*(f"x{i}" for i in range(len(features))), "y"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = known.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs)
    )
    held = {}
    for r in found.collect():
        cross = np.zeros((len(names), len(names)))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = r[f"c{i}_{j}"] * r.n
        held[r.fold] = (r.n, np.array([r[f"m{i}"] for i in range(len(names))]), cross)
    out = []
    for f in [None, *sorted(held)]:
        others = [s for g, s in held.items() if g != f]
        if not others:
            out.append((f, 0, None, None))
            continue
        n, mean, cross = _merge(others)
        w = np.linalg.lstsq(cross[:-1, :-1] + alpha * np.eye(len(features)), cross[:-1, -1], rcond=None)[0]
        out.append((f, n, w, mean[-1] - mean[:-1] @ w))
    return _frame(rows, out)


@dataclass
class _Fit:
    """One model on its way: coefficients (the last is the intercept) that held, the step that is tried, and its length."""

    fold: int | None
    n: int
    weights: tuple[float, float]
    at: np.ndarray
    step: np.ndarray = field(default=None)
    length: float = 1.0
    loss: float = float("inf")
    done: bool = False

    def tried(self) -> np.ndarray:
        return self.at if self.step is None else self.at + self.length * self.step

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray, tol: float) -> None:
        """Accept the tried point and take the next Newton step from it, or try half the step."""
        if not loss <= self.loss + 1e-12 * abs(self.loss):
            self.length /= 2
            self.done = self.length < 1e-9
            return
        self.at, self.loss, self.length = self.tried(), loss, 1.0
        self.step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        self.done = bool(np.abs(self.step).max() < tol)


def _sums(known: DataFrame, fits: list[_Fit], p: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Hessian of each fit at the point that it tries, over the rows outside its fold: one aggregate."""
    entry = lambda k, f: F.struct(F.lit(k).alias("k"), F.lit(f.fold).cast("int").alias("not_fold"), *(F.lit(float(v)).alias(f"b{j}") for j, v in enumerate(f.tried())), *(F.lit(w).alias(c) for c, w in zip(("w0", "w1"), f.weights, strict=True)))
    rows = known.withColumn("m", F.explode(F.array(*(entry(k, f) for k, f in enumerate(fits))))).filter("m.not_fold is null or m.not_fold != fold")
    x: list[Column] = [*(F.col(f"x{j}") for j in range(p)), F.lit(1.0)]
    margin = sum((F.col(f"m.b{j}") * x[j] for j in range(p)), F.col(f"m.b{p}"))
    rows = rows.select("m.k", "y", *(f"x{j}" for j in range(p)), margin.alias("margin"), F.when(F.col("y") > 0, F.col("m.w1")).otherwise(F.col("m.w0")).alias("s"))
    rows = rows.withColumn("q", 1 / (1 + F.exp(-F.col("margin"))))
    loss = F.log1p(F.exp(-F.abs("margin"))) + F.greatest(F.lit(0.0), F.when(F.col("y") > 0, -F.col("margin")).otherwise(F.col("margin")))
    pull, curve = F.col("s") * (F.col("q") - F.col("y")), F.col("s") * F.col("q") * (1 - F.col("q"))
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    found = rows.groupBy("k").agg(F.sum(F.col("s") * loss).alias("loss"), *(F.sum(pull * x[i]).alias(f"g{i}") for i in range(p + 1)), *(F.sum(curve * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs))
    out = {}
    for r in found.collect():
        h = np.zeros((p + 1, p + 1))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        out[r.k] = (r.loss, np.array([r[f"g{i}"] for i in range(p + 1)]), h)
    return out


def logistic_by_fold(rows: DataFrame, features: list[str], label: str, fold: str = "fold", c: float = 1.0, balanced: bool = False, tol: float = 1e-9, most_steps: int = 100) -> DataFrame:
    """(fold, n, coefficients, intercept) of each fold's L2 logistic regression on the other folds' n rows, and with a null fold that on all rows.

    c is the inverse strength, the intercept is unpenalised, balanced: the two classes (label over 0 or not) weigh alike.
    All models take their Newton steps together, a pass over `rows` each, so rows that are dear to compute should be
    stored. A fold whose training rows have one class only has no model (nulls). Fails if steps do not settle.
    """
    known, p = _known(rows, features, label, fold).withColumn("y", (F.col("y") > 0).cast("double")), len(features)
    counts = {r.fold: (r.n, int(r.pos)) for r in known.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).collect()}
    fits, none = [], []
    for f in [None, *sorted(counts)]:
        n, pos = (sum(v[i] for g, v in counts.items() if g != f) for i in (0, 1))
        if not 0 < pos < n:
            none.append((f, n, None, None))
            continue
        fits.append(_Fit(f, n, (n / (2 * (n - pos)), n / (2 * pos)) if balanced else (1.0, 1.0), np.zeros(p + 1)))
    penalty = np.append(np.ones(p), 0.0)
    for _ in range(most_steps):
        open_ = [f for f in fits if not f.done]
        if not open_:
            break
        for k, (loss, gradient, hessian) in _sums(known, open_, p).items():
            b = open_[k].tried()
            open_[k].take(c * loss + 0.5 * float(penalty @ b**2), c * gradient + penalty * b, c * hessian + np.diag(penalty), tol)
    else:
        raise RuntimeError(f"logistic regression has not settled after {most_steps} steps")
    return _frame(rows, sorted([(f.fold, f.n, f.at[:-1], f.at[-1]) for f in fits] + none, key=lambda m: (m[0] is not None, m[0] or 0)))


def predicted(rows: DataFrame, models: DataFrame, features: list[str], fold: str | None = "fold", logistic: bool = False, name: str = "predicted") -> DataFrame:
    """rows with the prediction of their own fold's model (out of fold); fold None: that of the model on all rows. Null without a model."""
    b = models.select(F.col("fold").alias("__fold"), F.col("coefficients").alias("__w"), F.col("intercept").alias("__b"))
    if fold is None:
        joined = rows.crossJoin(F.broadcast(b.filter("__fold is null")))  # one row
    else:
        joined = rows.join(F.broadcast(b.filter("__fold is not null")), F.col(fold) == F.col("__fold"), "left")  # a row a fold
    margin = sum((F.col("__w")[i] * F.col(f) for i, f in enumerate(features)), F.col("__b"))
    return joined.withColumn(name, 1 / (1 + F.exp(-margin)) if logistic else margin).drop("__fold", "__w", "__b")


def r2(df: DataFrame, predicted: str, target: str, by: list[str] = ()) -> DataFrame:
    """1 - squared errors / squared deviations from the group's mean; null where the target does not vary. Rows without both do not count."""
    by = list(by)
    known = df.filter(F.col(predicted).isNotNull() & F.col(target).isNotNull())
    error = F.avg(F.pow(F.col(target) - F.col(predicted), F.lit(2)))
    value = (1 - F.try_divide(error, F.var_pop(target))).alias("r2")
    return known.groupBy(*by).agg(value) if by else known.agg(value)


def ridge_report(rows: DataFrame, features: list[str], target: str, fold: str = "fold", alpha: float = 1.0) -> DataFrame:
    """fold, r2 and spearman of out-of-fold predictions."""
    out = predicted(rows, ridge_by_fold(rows, features, target, fold, alpha), features, fold)
    return null_safe_join(r2(out, "predicted", target, [fold]), spearman(out, "predicted", target, [fold]), [fold])


def logistic_report(rows: DataFrame, features: list[str], label: str, fold: str = "fold", c: float = 1.0, balanced: bool = False) -> DataFrame:
    """fold and auroc of out-of-fold probabilities; null for a fold of one class. A fold without a model is left out."""
    out = predicted(rows, logistic_by_fold(rows, features, label, fold, c, balanced), features, fold, True, "probability")
    return auroc(out, "probability", label, [fold])


def summary(report: DataFrame, *scores: str) -> DataFrame:
    """One row: <score>_mean and <score>_std (over folds, where the score is defined) of a report."""
    return report.agg(*(c for s in scores for c in (F.avg(s).alias(f"{s}_mean"), F.stddev_pop(s).alias(f"{s}_std"))))


def held_out(train: DataFrame, test: DataFrame, features: list[str], label: str, c: float = 1.0, balanced: bool = False) -> DataFrame:
    """One row: auroc and accuracy on test, and train_accuracy, of one logistic regression on all of train."""
    models = logistic_by_fold(train.withColumn("__whole", F.lit(0)), features, label, "__whole", c, balanced)
    scores = lambda rows: predicted(rows, models, features, None, True, "probability")
    right = F.avg(((F.col("probability") >= 0.5) == (F.col(label) > 0)).cast("double"))
    return auroc(scores(test), "probability", label).crossJoin(F.broadcast(scores(test).agg(right.alias("accuracy")))).crossJoin(F.broadcast(scores(train).agg(right.alias("train_accuracy"))))
