"""Splits, weight searches, regressions and split-conformal prediction sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.metrics import auroc, cumulative, mid_ranks, null_safe_join


def shuffled(df: DataFrame, key: str, stratum: str, seed: int, buckets: int = 1024) -> DataFrame:
    """df with __place (from 1) in the order of a hash of the key and seed within its stratum (nulls are one), and __size, the stratum's rows.

    Rows are numbered in hash buckets, which get their offsets from the buckets' counts, so few large strata do not
    end in few tasks.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    rows = df.withColumns({"__hash": h, "__bucket": F.shiftrightunsigned(h, 64 - (buckets - 1).bit_length())})
    counts = rows.groupBy(F.col(stratum).alias("__stratum"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__stratum")
    before = F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__stratum", "__b", before.alias("__before"), F.sum("__n").over(w).alias("__size"))
    within = F.row_number().over(Window.partitionBy(stratum, "__bucket").orderBy("__hash", key))
    placed = rows.withColumn("__within", within).join(offsets, F.col(stratum).eqNullSafe(F.col("__stratum")) & (F.col("__bucket") == F.col("__b")))
    return placed.withColumn("__place", F.col("__before") + F.col("__within")).drop("__hash", "__bucket", "__stratum", "__b", "__before", "__within")


def stratified_split(df: DataFrame, key: str, stratum: str, fraction: float, seed: int = 42) -> DataFrame:
    """df with is_test: round(n * fraction), half to even, of each stratum, by a hash of the key and seed."""
    return shuffled(df, key, stratum, seed).withColumn("is_test", F.col("__place") <= F.bround(F.col("__size") * fraction)).drop("__place", "__size")


def stratified_folds(df: DataFrame, key: str, stratum: str, k: int, seed: int = 42) -> DataFrame:
    """df with fold (0..k-1), dealt in turn within each stratum."""
    return shuffled(df, key, stratum, seed).withColumn("fold", ((F.col("__place") - 1) % k).cast("int")).drop("__place", "__size")


#: The weights that the search tries.
GRID = {
    "feature_weight": (0.3, 0.4, 0.5), "ruling_weight": (0.3, 0.4, 0.5), "graph_support_weight": (0.0, 0.1, 0.15, 0.2), "missing_channel_penalty": (0.1, 0.15, 0.2), "routing_uncertainty_weight": (0.1, 0.15, 0.2),
    "ambiguity_penalty": (0.05, 0.1, 0.15),
}


def weight_configs(spark, grid: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """config_id (in the order of the grid), its weights and article_weight, for feature and ruling weights of 1 at most together."""
    size, columns = 1, []
    for name, values in reversed(grid.items()):
        columns.append(F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("config_id") / size) % len(values) + 1).cast("int")).alias(name))
        size *= len(values)
    rows = spark.range(size).withColumnRenamed("id", "config_id").select("config_id", *reversed(columns))
    return rows.filter(F.col("feature_weight") + F.col("ruling_weight") <= 1).withColumn("article_weight", F.round(1 - F.col("feature_weight") - F.col("ruling_weight"), 3))


#: Pairs of a row and a config that a task of the search scores.
PAIRS = 1 << 19


def grid_search(rows: DataFrame, configs: DataFrame, score: Column, target: str, fold: str = "fold", most: int = PAIRS) -> DataFrame:
    """config_id and mean_score: each config's Spearman with the target, averaged over folds; best first, ties to the first config.

    Every row is scored by every config, which is the search, but a task sends only runs: a config's distinct scores in
    a fold, with their rows and the sum of the rows' target ranks, which no config changes and which are ranked once.
    A row without a target, or without a score under the first config, does not count; 0 where a correlation is undefined.
    configs: the table of the weights tried, which is broadcast. Rows are counted and dealt to tasks of about `most` pairs of
    a row and a config, so a task holds as many runs at any size.
    """
    tasks = max(1, -(-rows.count() * configs.count() // most))
    first = configs.orderBy("config_id").limit(1)
    known = rows.filter(F.col(target).isNotNull()).crossJoin(F.broadcast(first)).filter(score.isNotNull()).select(*rows.columns)
    placed = null_safe_join(known, mid_ranks(known, target, [fold], "__ry"), [fold, target])
    scored = placed.repartition(tasks).crossJoin(F.broadcast(configs)).select("config_id", fold, score.alias("__score"), "__ry").filter("__score is not null")
    runs = scored.groupBy("config_id", fold, "__score").agg(F.count(F.lit(1)).alias("n"), F.sum("__ry").alias("__sum_y"), F.sum(F.col("__ry") * F.col("__ry")).alias("__sum_yy"))
    x = F.col("before_n") + (F.col("n") + 1) / 2
    sums = cumulative(runs, ["config_id", fold], "__score", ["n"]).groupBy("config_id", fold).agg(
        F.sum("n").alias("__n"), F.sum(F.col("n") * x).alias("__x"), F.sum(F.col("n") * x * x).alias("__xx"), F.sum(x * F.col("__sum_y")).alias("__xy"), F.sum("__sum_y").alias("__y"), F.sum("__sum_yy").alias("__yy")
    )
    spread = lambda c: F.col("__n") * F.col(f"__{c}{c}") - F.col(f"__{c}") * F.col(f"__{c}")
    r = F.try_divide(F.col("__n") * F.col("__xy") - F.col("__x") * F.col("__y"), F.sqrt(spread("x") * spread("y")))
    return sums.groupBy("config_id").agg(F.avg(F.coalesce(r, F.lit(0.0))).alias("mean_score")).orderBy(F.desc("mean_score"), "config_id")


def weight_sweep(rows: DataFrame, a: str, b: str, label: str, weights: list[float]) -> DataFrame:
    """weight and the AUROC of weight * a + (1 - weight) * b."""
    table = F.explode(F.array(*map(F.lit, weights)))
    mixed = rows.withColumn("weight", table).select("weight", F.round(F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b), 12).alias("score"), label)
    return auroc(mixed, "score", label, ["weight"])


def fit_logistic(rows: DataFrame, features: list[str], label: str, c: float = 1.0, balanced: bool = False):
    """L2 logistic regression with inverse strength c (unpenalised intercept); balanced: classes weigh alike. Returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n, pos = rows.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
    heavy = F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))) if balanced and 0 < pos < n else F.lit(1.0)
    data = VectorAssembler(inputCols=features, outputCol="__features").transform(rows.withColumn("__weight", heavy))
    return LogisticRegression(featuresCol="__features", labelCol=label, weightCol="__weight", standardization=False, regParam=1 / (c * n), maxIter=200, tol=1e-10).fit(data)


def apply_logistic(rows: DataFrame, features: list[str], weights: list[float], intercept: float, name: str = "probability") -> DataFrame:
    margin = F.lit(intercept)
    for f, w in zip(features, weights, strict=True):
        margin = margin + F.col(f) * F.lit(w)
    return rows.withColumn(name, 1 / (1 + F.exp(-margin)))


def fit_ridge(rows: DataFrame, features: list[str], target: str, alpha: float = 1.0):
    """Ridge regression with penalty alpha; Spark scales its penalty by the deviation of the target."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    n, dev = rows.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
    data = VectorAssembler(inputCols=features, outputCol="__features").transform(rows)
    return LinearRegression(featuresCol="__features", labelCol=target, elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * (dev or 1.0) / n).fit(data)


def normalised(df: DataFrame, key: str = "query_id", score: str = "score") -> DataFrame:
    """Scores scaled to 0..1 within each query; 1 where all are equal."""
    w = Window.partitionBy(key)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("score", F.when(hi == lo, 1.0).otherwise((F.col(score) - lo) / (hi - lo)))


def calibration_scores(pool: DataFrame, gold: DataFrame, mode: str = "all", key: str = "query_id", item: str = "ref") -> DataFrame:
    """key and s: the largest ("all") or least ("any") nonconformity (1 - score) of the query's gold; infinite outside the pool.

    A reference that repeats in the pool counts with its last rank. gold holds a null item for queries without gold.
    """
    last = pool.groupBy(key, item).agg(F.max_by("score", "rank").alias("score"))
    rows = gold.select(key, item).distinct().join(last, [key, item], "left")
    s = F.coalesce(1 - F.col("score"), F.lit(float("inf")))
    return rows.groupBy(key).agg((F.max(s) if mode == "all" else F.min(s)).alias("s"))


def rank_of_quantile(n: int, alpha: float) -> int:
    return math.ceil((n + 1) * (1 - alpha))


def conformal_quantiles(scores: DataFrame, alphas: list[float], s: str = "s") -> DataFrame:
    """alpha, threshold and achievable: the k-th smallest score with k = ceil((n + 1)(1 - alpha)), infinite beyond n."""
    spark = scores.sparkSession
    n = scores.count()
    counts = scores.groupBy(s).agg(F.count(F.lit(1)).alias("n"))
    finite = cumulative(counts.filter(F.col(s) < float("inf")), [], s, ["n"])
    table = spark.createDataFrame([(float(a), rank_of_quantile(n, a)) for a in alphas], "alpha double, k long")
    hit = finite.join(F.broadcast(table), (F.col("before_n") < F.col("k")) & (F.col("before_n") + F.col("n") >= F.col("k")))
    out = table.join(hit.select("alpha", F.col(s).alias("threshold")), "alpha", "left")
    return out.select("alpha", F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"), (F.col("k") <= n).alias("achievable"))


def prediction_sets(pool: DataFrame, thresholds: DataFrame) -> DataFrame:
    """pool rows with 1 - score at most each alpha's threshold. thresholds: one row an alpha that the caller listed, so it is broadcast."""
    return pool.join(F.broadcast(thresholds), 1 - F.col("score") <= F.col("threshold"))


def set_sizes(pool: DataFrame, gold: DataFrame, queries: DataFrame, thresholds: DataFrame, mode: str = "all", key: str = "query_id", item: str = "ref") -> DataFrame:
    """alpha, key, size and covered (0 or 1) of every query at every alpha. A query without gold counts as covered; an infinite threshold takes the whole pool."""
    real = gold.filter(F.col(item).isNotNull()).select(key, item).distinct()
    flagged = pool.join(real.withColumn("__gold", F.lit(True)), [key, item], "left")
    # sizes and hits in one aggregate; a reference that repeats in the pool is one hit
    members = prediction_sets(flagged, thresholds).groupBy("alpha", key).agg(F.count(F.lit(1)).alias("size"), F.count_distinct(F.when(F.col("__gold"), F.col(item))).alias("hits"))
    frame = queries.select(key).distinct().join(real.groupBy(key).agg(F.count(F.lit(1)).alias("n_gold")), key, "left").crossJoin(F.broadcast(thresholds.select("alpha")))
    rows = frame.join(members, ["alpha", key], "left")
    got, due = F.coalesce("hits", F.lit(0)), F.coalesce("n_gold", F.lit(0))
    covered = (due == 0) | ((got == due) if mode == "all" else (got > 0))
    return rows.select("alpha", key, F.coalesce("size", F.lit(0)).alias("size"), covered.cast("int").alias("covered"))


def conformal_report(pool: DataFrame, gold: DataFrame, queries: DataFrame, thresholds: DataFrame, mode: str = "all", key: str = "query_id", item: str = "ref", share: float = 0.1) -> DataFrame:
    """Per alpha: coverage, ecr (the same in percent), mean set size, n, and worst_coverage: in percent, the least among the set sizes of coverage_by_size()."""
    sized = set_sizes(pool, gold, queries, thresholds, mode, key, item)
    out = sized.groupBy("alpha").agg(F.avg("covered").alias("coverage"), (100 * F.avg("covered")).alias("ecr"), F.avg("size").alias("mean_size"), F.count(F.lit(1)).alias("n"))
    return out.join(coverage_by_size(sized, share).select("alpha", (100 * F.col("worst_coverage")).alias("worst_coverage")), "alpha", "left")


def coverage_by_size(sized: DataFrame, share: float = 0.1) -> DataFrame:
    """Per alpha the worst coverage among set sizes above 0 that hold at least `share` of the queries."""
    total = sized.groupBy("alpha").agg(F.count(F.lit(1)).alias("all"))
    per = sized.filter("size > 0").groupBy("alpha", "size").agg(F.avg("covered").alias("coverage"), F.count(F.lit(1)).alias("n")).join(total, "alpha")
    return per.filter(F.col("n") >= F.col("all") * share).groupBy("alpha").agg(F.min("coverage").alias("worst_coverage"))


def pooled(pool: DataFrame, gold: DataFrame, key: str = "query_id", item: str = "ref") -> DataFrame:
    """Every pool row with label 1 if it is gold."""
    real = gold.select(key, item).distinct().withColumn("label", F.lit(1))
    return pool.join(real, [key, item], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def compare_methods(reports: DataFrame, base: str) -> DataFrame:
    """Per alpha: whether each other method keeps the base's coverage, its size ratio, and the method with the smallest."""
    b = reports.filter(F.col("method") == base).select("alpha", F.col("coverage").alias("base_coverage"), F.col("mean_size").alias("base_size"))
    rows = reports.filter(F.col("method") != base).join(b, "alpha")
    rows = rows.select("alpha", "method", (F.col("coverage") >= F.col("base_coverage")).alias("maintained"), F.try_divide(F.col("mean_size"), F.col("base_size")).alias("size_ratio"))
    best = rows.groupBy("alpha").agg(F.min_by("method", F.struct("size_ratio", "method")).alias("best"))
    return rows.join(best, "alpha")
