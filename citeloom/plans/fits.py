"""Queries of the cross-validated regressions, and SQL that takes the same steps.

Folds are the ids modulo five; the features are text length and a small number, the labels the quality marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import crossfit as X
from citeloom.plans.evaluation import SCORED, r6, scored

FEATURES = ["score", "sixth"]


def _rows(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).select("doc_id", "score", "label", "toxic", (F.col("other") / 6.0).alias("sixth"), F.pmod("doc_id", F.lit(5)).cast("int").alias("fold"))
    return rows.withColumn("recall", (F.col("sixth") + F.col("label") - 0.25 * F.col("toxic")) / 2)


ROWS = SCORED + ", rows as (select doc_id, score, label, toxic, other / 6.0::double as sixth, (doc_id % 5)::int as fold, (other / 6.0::double + label - 0.25::double * toxic) / 2 as recall from scored)\n"


def _coefficients(models: DataFrame) -> DataFrame:
    out = models.select("fold", "n", F.col("coefficients")[0].alias("a"), F.col("coefficients")[1].alias("b"), "intercept")
    return r6(out, "a", "b", "intercept")


def _ridge_folds(s: SparkSession, d: str) -> DataFrame:
    return _coefficients(X.ridge_by_fold(_rows(s, d), FEATURES, "recall"))


def _ridge_report(s: SparkSession, d: str) -> DataFrame:
    return r6(X.ridge_report(_rows(s, d), FEATURES, "recall"), "r2", "spearman")


def _ridge_summary(s: SparkSession, d: str) -> DataFrame:
    return r6(X.summary(X.ridge_report(_rows(s, d), FEATURES, "recall"), "r2"), "r2_mean", "r2_std")


def _logistic_folds(s: SparkSession, d: str) -> DataFrame:
    return _coefficients(X.logistic_by_fold(_rows(s, d), FEATURES, "label", c=0.5, balanced=True))


def _logistic_report(s: SparkSession, d: str) -> DataFrame:
    return r6(X.logistic_report(_rows(s, d), FEATURES, "label", c=0.5, balanced=True), "auroc")


def _platt(s: SparkSession, d: str) -> DataFrame:
    """Probabilities of one score, fitted on four folds and held out on the first."""
    rows = _rows(s, d)
    models = X.logistic_by_fold(rows, ["score"], "label")
    out = X.predicted(rows.filter("fold = 0"), models, ["score"], logistic=True, name="probability")
    return out.select("doc_id", F.round("probability", 6).alias("probability"))


def _fusion(s: SparkSession, d: str) -> DataFrame:
    """Held-out AUROC and accuracy of three features."""
    rows = _rows(s, d).withColumn("third", 1 - F.col("toxic") * 0.5)
    out = X.held_out(rows.filter("fold != 0"), rows.filter("fold = 0"), [*FEATURES, "third"], "label")
    return r6(out, "auroc", "accuracy", "train_accuracy")


# each fold's training rows, for a null fold all rows
TRAIN = ROWS + ", train as (select m.fold as m, r.* exclude (fold) from rows r join (select null::int as fold union all select distinct fold from rows) m on m.fold is null or m.fold <> r.fold)"
RIDGE = TRAIN + """,
sums as (select m, count(*) as n, avg(score) as mx, avg(sixth) as mz, avg(recall) as my, var_pop(score) * count(*) + 1 as xx, var_pop(sixth) * count(*) + 1 as zz, covar_pop(score, sixth) * count(*) as xz, covar_pop(score, recall) * count(*) as xy, covar_pop(sixth, recall) * count(*) as zy from train group by m),
fit as (select m, n, (xy * zz - zy * xz) / (xx * zz - xz * xz) as a, (zy * xx - xy * xz) / (xx * zz - xz * xz) as b, mx, mz, my from sums),
model as (select m as fold, n, a, b, my - a * mx - b * mz as intercept from fit)
"""
OUT = """, out as (select rows.*, a * score + b * sixth + intercept as p from rows join model using (fold)),
rp as (select fold, p, avg(r) as r from (select fold, p, row_number() over (partition by fold order by p) as r from out) group by all),
rt as (select fold, recall, avg(r) as r from (select fold, recall, row_number() over (partition by fold order by recall) as r from out) group by all),
report as (
  select fold, 1 - avg((recall - p) * (recall - p)) / var_pop(recall) as r2, covar_pop(rp.r, rt.r) / (stddev_pop(rp.r) * stddev_pop(rt.r)) as spearman
  from out join rp using (fold, p) join rt using (fold, recall) group by fold
)
"""


def newton_sql(features: list[str], c: float, balanced: bool, steps: int = 12) -> str:
    """Newton steps of the penalised logistic regression on TRAIN, one CTE each, with the equations solved by elimination."""
    p = len(features)
    x = [*features, "1"]
    weight = "case when label > 0 then n / (2.0 * pos) else n / (2.0 * (n - pos)) end" if balanced else "1.0::double"
    out = TRAIN + f",\nsizes as (select m, count(*)::double as n, sum(label)::double as pos from train group by m),\nw as (select train.*, n, {weight} as s from train join sizes on train.m is not distinct from sizes.m),\nb0 as (select m, {', '.join(f'0.0::double as b{i}' for i in range(p + 1))} from sizes)"
    for t in range(steps):
        margin = " + ".join(f"b{i} * {x[i]}" for i in range(p + 1))
        g = ", ".join(f"{c} * sum(s * (q - label) * {x[i]}) + {f'any_value(b{i})' if i < p else '0'} as g{i}" for i in range(p + 1))
        h = ", ".join(f"{c} * sum(s * q * (1 - q) * {x[i]} * {x[j]}) + {1 if i == j and i < p else 0} as e0_{i}_{j}" for i in range(p + 1) for j in range(p + 1))
        out += f",\nq{t} as (select w.*, b.* exclude (m), 1 / (1 + exp(-({margin}))) as q from w join b{t} b on w.m is not distinct from b.m),\ns{t} as (select m, {', '.join(f'any_value(b{i}) as b{i}' for i in range(p + 1))}, {g}, {h} from q{t} group by m)"
        # eliminate column k from the other rows; after the last the diagonal is left
        name = f"s{t}"
        for k in range(p + 1):
            a = lambda i, j: f"e{k}_{i}_{j}"  # noqa: B023, E731
            rows = [f"{a(i, j)} - {a(i, k)} / {a(k, k)} * {a(k, j)} as e{k + 1}_{i}_{j}" if i != k else f"{a(i, j)} as e{k + 1}_{i}_{j}" for i in range(p + 1) for j in range(p + 1)]
            right = [f"g{i} - {a(i, k)} / {a(k, k)} * g{k} as g{i}" if i != k else f"g{i}" for i in range(p + 1)]
            out += f",\n{name}_{k} as (select m, {', '.join(f'b{i}' for i in range(p + 1))}, {', '.join(right + rows)} from {name if k == 0 else f'{name}_{k - 1}'})"
        out += f",\nb{t + 1} as (select m, {', '.join(f'b{i} - g{i} / e{p + 1}_{i}_{i} as b{i}' for i in range(p + 1))} from {name}_{p})"
    return out + f",\nmodel as (select b.m as fold, sizes.n::bigint as n, {', '.join(f'b{i}' for i in range(p + 1))} from b{steps} b join sizes on b.m is not distinct from sizes.m)\n"


AUROC = "select {by} (sum(pos * (before + neg / 2.0)) / (sum(pos) * sum(neg))) as auroc from (select *, coalesce(sum(neg) over (partition by fold order by p rows between unbounded preceding and 1 preceding), 0) as before from (select fold, p, sum(label) as pos, count(*) - sum(label) as neg from {rows} group by fold, p))"

QUERIES = {
    "n5_logistic_folds": _logistic_folds,
    "n5_logistic_report": _logistic_report,
    "n5_platt": _platt,
    "n5_fusion": _fusion,
    "n6_ridge_folds": _ridge_folds,
    "n6_ridge_report": _ridge_report,
    "n6_ridge_summary": _ridge_summary,
}

_TWO = newton_sql(FEATURES, 0.5, True)
_THREE = newton_sql([*FEATURES, "(1 - toxic * 0.5::double)"], 1.0, False)
ORACLE = {
    "n5_logistic_folds": _TWO + "select fold, n, round(b0, 6) as a, round(b1, 6) as b, round(b2, 6) as intercept from model",
    "n5_logistic_report": _TWO + ", out as (select fold, label, 1 / (1 + exp(-(b0 * score + b1 * sixth + b2))) as p from rows join model using (fold))\nselect fold, round(auroc, 6) as auroc from (" + AUROC.format(by="fold,", rows="out") + " group by fold)",
    "n5_platt": newton_sql(["score"], 1.0, False) + "select doc_id, round(1 / (1 + exp(-(b0 * score + b1))), 6) as probability from rows join model using (fold) where fold = 0",
    # the model of the first fold is fitted on all others
    "n5_fusion": _THREE + ", probs as (select r.fold = 0 as test, 0 as fold, label, 1 / (1 + exp(-(b0 * score + b1 * sixth + b2 * (1 - toxic * 0.5::double) + b3))) as p from rows r, model where model.fold = 0), tested as (select * from probs where test)\nselect round(auroc, 6) as auroc, (select round(avg(((p >= 0.5) = (label > 0))::int), 6) from tested) as accuracy, (select round(avg(((p >= 0.5) = (label > 0))::int), 6) from probs where not test) as train_accuracy from (" + AUROC.format(by="", rows="tested") + ")",
    "n6_ridge_folds": RIDGE + "select fold, n, round(a, 6) as a, round(b, 6) as b, round(intercept, 6) as intercept from model",
    "n6_ridge_report": RIDGE + OUT + "select fold, round(r2, 6) as r2, round(spearman, 6) as spearman from report",
    "n6_ridge_summary": RIDGE + OUT + "select round(avg(r2), 6) as r2_mean, round(stddev_pop(r2), 6) as r2_std from report",
}
