"""Human labels against model ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import num


def agreement(alignment: DataFrame, key: str = "ride_id") -> DataFrame:
    """Counts of an alignment's outcomes, with precision and recall at three decimals, half-even."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    rows = alignment.groupBy(key).agg(n("matched").alias("n_matched"), n("label_only").alias("n_label_only"), n("model_only").alias("n_model_only"))
    share = lambda other: F.coalesce(F.bround(F.try_divide(F.col("n_matched").cast("double"), (F.col("n_matched") + F.col(other)).cast("double")), 3), num(0))
    return rows.withColumn("n_labels", F.col("n_matched") + F.col("n_label_only")).withColumn("n_model_hits", F.col("n_matched") + F.col("n_model_only")).withColumn("precision", share("n_model_only")).withColumn("recall", share("n_label_only"))


def patterns(pairs: DataFrame, key: str = "ride_id") -> DataFrame:
    """Per entity, from rows (outcome, label_type, label_visual, label_action, model_type, model_visual, model_action):
    agreement on matched pairs where both visuals are set, mean scores, and the least of the larger score."""
    matched, scored = F.col("outcome") == "matched", (F.col("outcome") == "matched") & (F.col("label_visual") != 0) & (F.col("model_visual") != 0)
    mean = lambda v, cond, places: F.bround(F.avg(F.when(cond, v).cast("double")), places)
    return pairs.groupBy(key).agg(
        F.count_if(scored).alias("n_scored"),
        mean(F.col("model_visual") - F.col("label_visual"), scored, 2).alias("visual_mean_diff"),
        mean(F.col("model_action") - F.col("label_action"), scored, 2).alias("action_mean_diff"),
        F.count_if(scored & (F.col("label_type") == F.col("model_type"))).alias("n_same_type"),
        mean((F.col("label_type") == F.col("model_type")).cast("int"), scored, 2).alias("type_rate"),
        mean(F.col("model_visual"), matched, 1).alias("avg_matched_visual"),
        mean(F.col("model_action"), matched, 1).alias("avg_matched_action"),
        mean(F.col("model_visual"), F.col("outcome") == "model_only", 1).alias("avg_model_only_visual"),
        mean(F.col("model_action"), F.col("outcome") == "model_only", 1).alias("avg_model_only_action"),
        F.min(F.when(matched, F.greatest("model_visual", "model_action"))).alias("min_matched_max"),
    )


def counts_by_type(pairs: DataFrame, outcome: str, kind: str, key: str = "ride_id") -> DataFrame:
    """(key, kind, n): rows of an outcome by type, unknown where it is missing."""
    return pairs.where(F.col("outcome") == outcome).groupBy(key, F.coalesce(F.when(F.col(kind) != "", F.col(kind)), F.lit("unknown")).alias(kind)).agg(F.count(F.lit(1)).alias("n"))


def roll_up(per_entity: DataFrame) -> DataFrame:
    """One row over all entities: sums, and micro-averaged precision and recall."""
    total = per_entity.agg(F.count(F.lit(1)).alias("n_rides"), *[F.sum(c).alias(c) for c in ("n_labels", "n_model_hits", "n_matched", "n_label_only", "n_model_only")])
    share = lambda c: F.bround(F.try_divide(F.col("n_matched").cast("double"), F.col(c).cast("double")), 3)
    return total.withColumn("precision", share("n_model_hits")).withColumn("recall", share("n_labels"))


def top_overflags(pairs: DataFrame, limit: int = 15, key: str = "ride_id", order: str = "hit_id") -> DataFrame:
    """The model_only rows of each entity with the largest score, at most `limit`, as a report."""
    rows = pairs.where("outcome = 'model_only'").withColumn("top_score", F.greatest("model_visual", "model_action"))
    w = Window.partitionBy(key).orderBy(F.desc("top_score"), order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def missed(pairs: DataFrame, key: str = "ride_id", order: str = "label_id") -> DataFrame:
    """The label_only rows of all entities with their ratings, numbered by entity in label order, as a report."""
    rows = pairs.where("outcome = 'label_only'").select(key, order, "label_type", "label_visual", "label_action")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)))
