"""Sinks. Full states are overwritten partition by partition, so that a rerun writes the same and touches no other entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import num


def save_partitioned(df: DataFrame, path: str, by: list[str], order: list[str] = (), fmt: str = "parquet") -> None:
    """Overwrites the partitions that `df` holds, rows in order within files; others stay."""
    rows = df.repartition(*[F.col(c) for c in by])
    rows = rows.sortWithinPartitions(*by, *order) if order else rows
    rows.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).save(path)


def save_moments(df: DataFrame, path: str, key: str = "ride_id", t: str = "ride_time_secs", fmt: str = "parquet") -> None:
    save_partitioned(df, path, [key], [t], fmt)


def save_training(df: DataFrame, path: str, key: str = "ride_id") -> None:
    """Training rows of the rides in `df`; a rerun replaces a ride's rows and doesn't double them."""
    save_partitioned(df, path, [key])


def save_reports(df: DataFrame, path: str) -> None:
    save_partitioned(df, path, ["date_folder", "provider", "model_key"])


def save_variants(variants: dict[str, DataFrame], path: str, key: str = "ride_id") -> None:
    """Selections side by side in one table with a `variant` column."""
    parts = [df.withColumn("variant", F.lit(name)) for name, df in variants.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    save_partitioned(out, path, ["variant", key])


def save_ranker(spark, model: dict, path: str) -> None:
    """Weights and counts of a ranker as a one-row table."""
    row = [(float(model["intercept"]), {k: float(v) for k, v in model["weights"].items()}, int(model["n"]), int(model["n_positive"]))]
    spark.createDataFrame(row, "intercept double, weights map<string,double>, n long, n_positive long").write.mode("overwrite").parquet(path)


def load_ranker(spark, path: str) -> dict:
    return spark.read.parquet(path).first().asDict()


def reviewer_rows(candidates: DataFrame) -> DataFrame:
    """What a reviewer sees of candidates, best first."""
    return candidates.select("ride_id", "id", "clip_name", "video_start", "video_end", "anchor_video_secs", "ride_time_secs", "score", "sources", "notes").orderBy("ride_id", F.desc("score"), "ride_time_secs")


def enriched_hits(hits: DataFrame, clips: DataFrame, key: str = "ride_id") -> DataFrame:
    """Hits with their ride second where it is missing, at one decimal; write them to a new path."""
    at = F.col("clip_start") + F.coalesce("anchor_video_secs", "video_secs", num(0))
    rows = hits.join(clips.select(key, "clip_name", "clip_start"), [key, "clip_name"], "left")
    return rows.withColumn("ride_time_secs", F.coalesce("ride_time_secs", F.bround(at, 1))).drop("clip_start")


def manifest(frames: DataFrame, key: str = "ride_id") -> DataFrame:
    """One row per ride: its frames, in order, as an array."""
    return frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ride_sec", "clip_name", "video_sec"))).alias("frames"))


def upsert(edits: DataFrame, path: str, by: list[str], on: list[str], order: list[str] = (), gone: str | None = None, fmt: str = "parquet") -> None:
    """Rows of a table at `path`, partitioned by `by`, replaced by the `edits` that have their `on`; others of these partitions
    stay, new ones are added, and rows that an edit marks in the boolean `gone` go. Only the partitions of `edits` are read
    and written, so a rerun writes the same and other entities aren't touched. Of edits of one row the last by `order` counts.

    What is to be written is checkpointed before the partitions are replaced, so that no task reads what another overwrites.
    """
    spark, keys = edits.sparkSession, [*by, *on]
    rank = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in (order or on)])
    last = edits.withColumn("upsert_rank", F.row_number().over(rank)).where("upsert_rank = 1").drop("upsert_rank")
    out = last.where(~F.coalesce(gone, F.lit(False))).drop(gone) if gone else last
    if exists(spark, path):
        there = spark.read.format(fmt).schema(out.schema).load(path).join(last.select(*by).distinct(), by, "left_semi")
        out = there.join(last.select(*keys), keys, "left_anti").select(*out.columns).unionByName(out)
        emptied = last.select(*by).distinct().join(out.select(*by).distinct(), by, "left_anti")
        if emptied.take(1):
            raise ValueError(f"an edit would leave nothing of a partition, which an overwrite by partition can't express: {emptied.first().asDict()}")
    save_partitioned(written_once(out), path, by, list(on), fmt)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there are rows to read at `path`."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def written_once(df: DataFrame) -> DataFrame:
    """`df` cut from what it is read from, in the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def save_selections(edits: DataFrame, path: str, key: str = "ride_id", stable: str = "stable_id", order: list[str] = ()) -> None:
    """A reviewer's selections by stable id; those of other candidates of the ride, and of other rides, stay."""
    upsert(edits, path, [key], [stable], order)


def save_labels(edits: DataFrame, path: str, key: str = "ride_id", position: str = "seq", order: list[str] = (), gone: str | None = None) -> None:
    """Edits of labels by their position within the ride; an edit may mark a label as gone."""
    upsert(edits, path, [key], [position], order, gone)


def sync_reports(offsets: DataFrame, reports: DataFrame, key: str = "ride_id", clip: str = "clip_name") -> DataFrame:
    """One row per ride as in its clock report: offset_secs, confidence, method, notes and detected_at of `reports`, and the map
    `per_chapter` of `offsets` (key, clip, offset), empty where a ride has none."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(clip).alias("k"), F.col("offset").cast("double").alias("v"))))
    maps = offsets.groupBy(key).agg(F.map_from_entries(entries).alias("per_chapter"))
    none = F.create_map().cast("map<string,double>")
    return reports.select(key, "offset_secs", "confidence", "method", "notes", "detected_at").join(maps, key, "left").withColumn("per_chapter", F.coalesce("per_chapter", none))


def save_sync(offsets: DataFrame, reports: DataFrame, path: str, key: str = "ride_id") -> None:
    """Nested clock reports as JSON, a partition for each ride; a rerun replaces a ride's. `readers.saved_sync` reads them."""
    save_partitioned(sync_reports(offsets, reports, key), path, [key], fmt="json")
