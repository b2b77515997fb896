"""A learned ranker of candidates: features, balanced logistic regression on scaled features, and its scores."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import VISION_SOURCES, num, stars_from_notes

FEATURES = ("visual", "action", "visual_x_action", "score", "source_count", "has_gemini", "has_telemetry", "has_strava", "has_label", "strava_stars")


def features(rows: DataFrame, visual: Column, action: Column) -> DataFrame:
    """The ten features of candidates (score, sources, notes); no sources count as one."""
    flag = lambda s: F.coalesce(F.array_contains("sources", s), F.lit(False)).cast("double")
    count = F.coalesce(F.when(F.size("sources") > 0, F.size("sources")), F.lit(1)).cast("double")
    vision = F.coalesce(F.arrays_overlap("sources", F.array(*map(F.lit, VISION_SOURCES))), F.lit(False)).cast("double")
    v, a = visual.cast("double"), action.cast("double")
    return rows.withColumns({"visual": v, "action": a}).withColumns({"visual_x_action": F.col("visual") * F.col("action"), "source_count": count, "has_gemini": vision, "has_telemetry": flag("telemetry"), "has_strava": flag("strava"), "has_label": flag("label"), "strava_stars": stars_from_notes(F.col("notes"))})


def train(rows: DataFrame, names: list[str], label: str = "selected", key: str = "ride_id", least_rows: int = 100, least_keys: int = 3) -> dict | None:
    """{intercept, weights, n, n_positive}: L2 logistic regression with balanced classes on standardised features, the
    weights put back to the features' own scale. None below the least rows or entities, or with one class only."""
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("p"), F.countDistinct(key).alias("k"), *[f(c).alias(f"{n}_{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, p = stats["n"], stats["p"] or 0
    if n < least_rows or stats["k"] < least_keys or p in (0, n):
        return None
    mean = {c: stats[f"m_{c}"] for c in names}
    scale = {c: stats[f"s_{c}"] if stats[f"s_{c}"] >= 1e-6 else 1.0 for c in names}
    weight = F.when(F.col(label).cast("int") == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p)))
    scaled = rows.select(F.col(label).cast("double").alias("y"), weight.alias("w"), *[((F.col(c) - mean[c]) / scale[c]).alias(c) for c in names])
    data = VectorAssembler(inputCols=names, outputCol="x").transform(scaled)
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", standardization=False, regParam=1.0 / n, elasticNetParam=0.0, maxIter=100).fit(data)
    weights = {c: float(b) / scale[c] for c, b in zip(names, model.coefficients, strict=True)}
    return {"intercept": float(model.intercept) - sum(weights[c] * mean[c] for c in names), "weights": weights, "n": n, "n_positive": p}


def predicted(rows: DataFrame, model: dict, name: str = "learned_score") -> DataFrame:
    """`rows` with intercept plus the weighted sum of features; missing ones are 0."""
    terms = [F.coalesce(F.col(c).cast("double"), num(0)) * w for c, w in model["weights"].items()]
    return rows.withColumn(name, reduce(lambda a, b: a + b, terms, num(model["intercept"])))


def validated(rows: DataFrame, names: list[str], label: str = "selected", key: str = "ride_id", folds: int = 5) -> float | None:
    """Mean area under the ROC curve over folds of whole entities, at most one fold per entity."""
    entities = rows.select(key).distinct().count()
    folds = min(folds, entities)
    found = []
    for i in range(folds):
        fold = F.pmod(F.xxhash64(key), F.lit(folds)) == i
        model = train(rows.where(~fold), names, label, key, 1, 1)
        held = rows.where(fold)
        if model and held.select(label).distinct().count() == 2:
            scored = predicted(held, model).select(F.col(label).cast("double").alias("label"), F.col("learned_score").alias("rawPrediction"))
            found.append(BinaryClassificationEvaluator().evaluate(scored))
    return sum(found) / len(found) if found else None


def status(rows: DataFrame, label: str = "selected", key: str = "ride_id", least_rows: int = 100) -> DataFrame:
    """Rows, positives and their rate, entities, and rows that are still missing for training."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("n_positive"), F.bround(F.avg(F.col(label).cast("double")), 3).alias("rate"), F.countDistinct(key).alias("n_keys")).withColumn("remaining", F.greatest(F.lit(0), F.lit(least_rows) - F.col("n")))


def top_weights(spark: SparkSession, model: dict, limit: int = 5) -> DataFrame:
    """(feature, weight, place): a model's largest weights, by size without sign, at most `limit`, as a report."""
    ordered = sorted(model["weights"].items(), key=lambda x: (-abs(x[1]), x[0]))[:limit]
    return spark.createDataFrame([(name, float(w), i) for i, (name, w) in enumerate(ordered, 1)], "feature string, weight double, place int")
