"""Sources. JSON is read with explicit schemas that hold old and new keys; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import chapter, label_on_new_scale, num, stable_id

SEMICIRCLE = 180.0 / 2**31
RUBRIC = "rubric struct<light:int,composition:int,motion:int,scenery:int,subject:int>"
LABELS = "ride_time_secs double, ride_time_str string, type string, visual int, action int, scale_version int, must_include boolean, notes string, clip_name string, video_secs double"
HITS = f"clip_name string, video_start double, video_end double, anchor_video_secs double, peak_offset double, {RUBRIC}, raw_sum int, clip_type string, crop_x int, reason string, ride_time_secs double, video_secs double, visual int, action int, _corrupt_record string"
MOMENTS = f"id string, clip_name string, video_start double, video_end double, anchor_video_secs double, ride_time_secs double, score double, source string, sources array<string>, {RUBRIC}, notes string, status string, rating int, final_trim_secs double, user_anchor_override double, user_in_out array<double>, portrait_crop_bias double"
SYNC = "offset_secs double, confidence double, method string, notes string, per_chapter map<string,double>, detected_at string"
PROBE = "path string, format struct<duration:string,tags:struct<creation_time:string>>, streams array<struct<codec_type:string,width:int,height:int,r_frame_rate:string,tags:struct<creation_time:string>>>"
TRAINING = "ride_id string, candidate_idx int, selected int, " + ", ".join(f"{c} double" for c in ("visual", "action", "visual_x_action", "score", "source_count", "has_gemini", "has_telemetry", "has_strava", "has_label", "strava_stars"))
ROW = "ride_time_secs double, label_type string, label_visual int, label_action int, model_clip_type string, model_visual int, model_action int, gemini_clip_type string, gemini_visual int, gemini_action int"
REPORTS = f"date_folder string, provider string, model string, n_labels int, n_model_hits int, n_gemini_hits int, n_matched int, n_label_only int, n_model_only int, n_gemini_only int, matched array<struct<{ROW.replace(' ', ':').replace(',:', ',')}>>"
OSM = "elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
EFFORTS = "activity_id long, start_date string, segment_efforts array<struct<start_date:string,elapsed_time:double,segment:struct<id:long,name:string,starred:boolean,distance:double>>>"
FRAMES = "interval double, frames array<struct<ride_secs:long,file:string>>, clips array<struct<name:string,start:double,duration:double>>"
# Kinds of places and their rank, the smaller preferred.
PLACE_RANK = {"neighbourhood": 1, "quarter": 1, "hamlet": 2, "village": 2, "suburb": 3, "town": 3, "city": 4}


def json_rows(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)


def or_else(first: Column, second: Column) -> Column:
    """The first value unless it is null or 0."""
    return F.coalesce(F.when(first != 0, first), second)


def normalised_points(records: DataFrame) -> DataFrame:
    """Decoded records to points: rows without a time go, semicircles become degrees, enhanced values win unless 0."""
    return records.where("timestamp is not null").select("ride_id", "seq", F.col("timestamp").cast("timestamp_ntz").alias("ts"), (F.col("position_lat") * SEMICIRCLE).alias("lat"), (F.col("position_long") * SEMICIRCLE).alias("lon"), or_else(F.col("enhanced_speed"), F.col("speed")).alias("speed"), or_else(F.col("enhanced_altitude"), F.col("altitude")).alias("altitude"), "power", "heart_rate", "cadence", "temperature", "distance")


def first_session(sessions: DataFrame, key: str = "ride_id", seq: str = "seq") -> DataFrame:
    """Totals of each ride's first session."""
    w = Window.partitionBy(key).orderBy(seq)
    rows = sessions.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return rows.select(key, "total_elapsed_time", "total_timer_time", "total_distance", or_else(F.col("enhanced_avg_speed"), F.col("avg_speed")).alias("avg_speed"), or_else(F.col("enhanced_max_speed"), F.col("max_speed")).alias("max_speed"))


def sensors(points: DataFrame, key: str = "ride_id") -> DataFrame:
    return points.groupBy(key).agg(F.bool_or(F.col("power").isNotNull()).alias("has_power"), F.bool_or(F.col("cadence").isNotNull()).alias("has_cadence"))


def clip_catalogue(probes: DataFrame) -> DataFrame:
    """Clips from probe documents: creation time of the container, else of the first video stream that has one."""
    video = F.filter("streams", lambda s: s["codec_type"] == "video")
    with_time = F.filter(video, lambda s: s["tags"]["creation_time"].isNotNull())
    first = F.get(video, F.lit(0))
    rate = first["r_frame_rate"]
    fps = F.try_divide(F.split_part(rate, F.lit("/"), F.lit(1)).try_cast("double"), F.coalesce(F.split_part(rate, F.lit("/"), F.lit(2)).try_cast("double"), num(1)))
    made = F.coalesce(F.col("format.tags.creation_time"), F.get(with_time, F.lit(0))["tags"]["creation_time"])
    return probes.select(F.regexp_extract("path", r"[^/]*$", 0).alias("clip_name"), F.regexp_replace(made, "Z$", "").try_cast("timestamp_ntz").alias("creation_time"), F.col("format.duration").try_cast("double").alias("duration_secs"), first["width"].alias("width"), first["height"].alias("height"), fps.alias("fps"))


def stitched(clips: DataFrame, key: list[str], order: list[str], duration: str = "duration_secs") -> DataFrame:
    """`clips` with `shift_secs`, the summed length of the recording's chapters before each."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return clips.withColumn("shift_secs", F.coalesce(F.sum(duration).over(w), num(0)))


def stitched_chapters(clips: DataFrame, key: str = "ride_id") -> DataFrame:
    """Clips with recording and chapter from their names; each starts at its own creation time, later by its recording's earlier
    chapters."""
    recording, number = chapter(F.col("clip_name"))
    rows = stitched(clips.withColumn("recording", recording).withColumn("chapter", number), [key, "recording"], ["chapter", "clip_name"])
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("shift_secs").cast("decimal(18,6)"))
    return rows.withColumn("start_ts", F.col("creation_time") + shift)


def segment_efforts(activities: DataFrame) -> DataFrame:
    """Efforts of an activity, starred ones only if there are any, with the start as an offset from the activity's."""
    rows = activities.select("activity_id", "start_date", F.posexplode("segment_efforts").alias("seq", "e"))
    rows = rows.withColumn("starred", F.coalesce("e.segment.starred", F.lit(False)))
    rows = rows.withColumn("any_starred", F.bool_or("starred").over(Window.partitionBy("activity_id"))).where("starred or not any_starred")
    at = lambda c: F.regexp_replace(c, "Z$", "").try_cast("timestamp_ntz")
    start = F.timestamp_diff("MICROSECOND", at(F.col("start_date")), at(F.col("e.start_date"))) / F.lit(1e6)
    return rows.select("activity_id", "seq", F.col("e.segment.id").alias("segment_id"), F.col("e.segment.name").alias("name"), "starred", start.alias("start_secs"), F.col("e.elapsed_time").alias("elapsed_secs"), F.col("e.segment.distance").alias("distance"))


def with_star_counts(efforts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(efforts with star_count, starred segments that the cache lacks); without a count 100 if starred, else 0."""
    rows = efforts.join(cache.select("segment_id", F.col("star_count").alias("cached")), "segment_id", "left")
    counted = rows.withColumn("star_count", F.coalesce("cached", F.when(F.col("starred"), 100).otherwise(0))).drop("cached")
    return counted, efforts.where("starred").select("segment_id").distinct().join(cache, "segment_id", "left_anti")


def upgraded_labels(labels: DataFrame) -> DataFrame:
    """Labels on the scale of version 2."""
    new = lambda c: label_on_new_scale(F.col(c), F.col("scale_version"))
    return labels.withColumns({"visual": new("visual"), "action": new("action"), "scale_version": F.greatest(F.coalesce("scale_version", F.lit(1)), F.lit(2))})


def cached_hits(hits: DataFrame, fingerprint: str | None = None, file: str = "file") -> DataFrame:
    """Hits of files of one model (all without a fingerprint): the name, less its suffix, ends in `_m` and the fingerprint, or
    holds these and `_l`. Malformed rows are left out."""
    ok = hits.where("_corrupt_record is null and clip_name is not null") if "_corrupt_record" in hits.columns else hits
    stem = F.regexp_replace(F.regexp_extract(file, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    mine = stem.endswith(f"_m{fingerprint}") | stem.contains(f"_m{fingerprint}_l")
    return (ok.where(mine) if fingerprint else ok).withColumn("position", F.coalesce("anchor_video_secs", "video_secs", num(0)))


def lenient_moments(rows: DataFrame) -> DataFrame:
    """Moments with ids backfilled, one source made a list, and defaults."""
    return rows.withColumns({"id": F.coalesce("id", stable_id(F.col("clip_name"), F.col("anchor_video_secs"))), "sources": F.coalesce(F.when(F.size("sources") > 0, F.col("sources")), F.array("source")), "status": F.coalesce("status", F.lit("pending")), "rating": F.coalesce("rating", F.lit(0)), "notes": F.coalesce("notes", F.lit("")), "portrait_crop_bias": F.coalesce("portrait_crop_bias", num(0))})


def selection_input(rows: DataFrame, key: str = "ride_id") -> DataFrame:
    """Where any row of a file has a status, the approved and automatic ones with the reviewer's changes; else all rows."""
    any_status = F.bool_or(F.col("status").isNotNull()).over(Window.partitionBy(key))
    rows = rows.withColumn("reviewed", any_status).where("not reviewed or status in ('approved', 'auto')")
    fold = lambda c, other: F.when(F.col("reviewed"), F.coalesce(other, F.col(c))).otherwise(F.col(c))
    return rows.withColumns({"anchor_video_secs": fold("anchor_video_secs", F.col("user_anchor_override")), "video_start": fold("video_start", F.get("user_in_out", F.lit(0))), "video_end": fold("video_end", F.get("user_in_out", F.lit(1)))}).drop("reviewed")


def hydrated(rows: DataFrame) -> DataFrame:
    """Candidates with an anchor (the span's middle), an id and sources backfilled."""
    anchor = F.coalesce("anchor_video_secs", (F.col("video_start") + F.col("video_end")) / 2)
    rows = rows.withColumn("anchor_video_secs", anchor)
    return rows.withColumns({"id": F.coalesce("id", stable_id(F.col("clip_name"), F.col("anchor_video_secs"))), "sources": F.coalesce("sources", F.array("source"))})


def saved_sync(spark: SparkSession, path: str, key: str = "ride_id", kind: str = "string") -> DataFrame:
    """Clock reports that `sinks.save_sync` wrote: the key, its type as given, and the report's fields."""
    return spark.read.schema(f"{SYNC}, `{key}` {kind}").json(path)


def clip_offset_rows(sync: DataFrame, key: str = "ride_id") -> DataFrame:
    """(key, clip_name, offset) of a clock report's map."""
    return sync.select(key, F.explode("per_chapter").alias("clip_name", "offset"))


def training_rows(rows: DataFrame) -> DataFrame:
    """Training examples with missing features 0."""
    return rows.fillna(0.0)


def preferred_reports(reports: DataFrame, provider: str, model: str, scoped_name: str, key: str = "date_folder", file: str = "file") -> DataFrame:
    """One report per ride: the model's own file beats the old common name; another provider or model is rejected; old
    keys are renamed."""
    same = (F.coalesce("provider", F.lit(provider)) == provider) & (F.coalesce("model", F.lit(model)) == model)
    rows = reports.where(same).withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col(file).endswith(scoped_name), 0).otherwise(1), file))).where("rn = 1").drop("rn")
    return rows.withColumns({"n_model_hits": F.coalesce("n_model_hits", "n_gemini_hits"), "n_model_only": F.coalesce("n_model_only", "n_gemini_only")}).drop("n_gemini_hits", "n_gemini_only")


def scaled_gps(raw: DataFrame) -> DataFrame:
    """Camera positions from integers and per-stream divisors; time is days and scaled seconds after 2000-01-01."""
    secs = (F.col("days") * 86400 + F.col("secs") / F.col("secs_scale")).cast("decimal(20,6)")
    ts = F.expr("timestamp_ntz'2000-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)
    scaled = lambda c: (F.col(c) / F.col(f"{c}_scale")).alias(c)
    return raw.select("clip_name", "idx", ts.alias("ts"), *map(scaled, ("lat", "lon", "alt", "speed_mps", "dop")), "fix")


def osm_ways(osm: DataFrame) -> DataFrame:
    """(way_id, name, ref, idx, lat, lon): vertices of named or numbered ways of two or more."""
    rows = osm.select(F.explode("elements").alias("e")).where("e.type = 'way' and (e.tags['name'] is not null or e.tags['ref'] is not null) and size(e.geometry) >= 2")
    return rows.select(F.col("e.id").alias("way_id"), F.expr("e.tags['name']").alias("name"), F.expr("e.tags['ref']").alias("ref"), F.posexplode("e.geometry").alias("idx", "p")).select("way_id", "name", "ref", "idx", "p.lat", "p.lon")


def osm_parks(osm: DataFrame) -> DataFrame:
    """(poly_id, name, idx, lat, lon): vertices of named closed rings of four or more."""
    rows = osm.select(F.explode("elements").alias("e")).where("e.tags['name'] is not null and size(e.geometry) >= 4")
    rows = rows.where(F.element_at("e.geometry", 1) == F.element_at("e.geometry", -1))
    return rows.select(F.col("e.id").alias("poly_id"), F.expr("e.tags['name']").alias("name"), F.posexplode("e.geometry").alias("idx", "p")).select("poly_id", "name", "idx", "p.lat", "p.lon")


def osm_places(osm: DataFrame) -> DataFrame:
    """(name, rank, lat, lon) of named places of a ranked kind."""
    rank = F.create_map(*[F.lit(x) for pair in PLACE_RANK.items() for x in pair])
    rows = osm.select(F.explode("elements").alias("e")).select(F.expr("e.tags['name']").alias("name"), rank[F.expr("e.tags['place']")].alias("rank"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"))
    return rows.where("name is not null and rank is not null and lat is not null and lon is not null")


def ride_paths(file: Column, root: str) -> tuple[Column, Column]:
    """(ride folder, path within it) of a file below `root`. The ride folder is the topmost folder below the root that is named by
    a date, else the nearest such folder of the whole path (the root may lie in one); a file in no such folder has the topmost
    folder below the root, or none."""
    top = root.rstrip("/").removeprefix("file:").lstrip("/") + "/"
    after = F.locate(f"/{top}", file)
    below = F.when(after > 0, F.substr(file, after + len(top) + 1, F.length(file))).otherwise(file)
    day = r"\d{4}-\d{2}-\d{2}"
    inner, outer = rf"^(?:.*?/)??({day})/(.+)$", rf"^.*/({day})/(.+)$"
    part = lambda i: F.when(below.rlike(inner), F.regexp_extract(below, inner, i)).when(file.rlike(outer), F.regexp_extract(file, outer, i)).otherwise(F.regexp_extract(below, "^(?:([^/]+)/)?(.*)$", i))
    return part(1), part(2)


#: Folders that a listing leaves out by their names, and how deep below the root they are looked for by name (fixed values).
UNLISTED, DEEPEST = ("_work",), 3


def file_inventory(spark: SparkSession, path: str, glob: str = "*", unlisted: tuple[str, ...] = UNLISTED) -> DataFrame:
    """(ride_folder, path, ride_path, suffix, length, modified) of files below `path`: `path` is the whole one, `ride_path` that
    within the ride folder, both told by `ride_paths`. Content isn't read. Folders whose names begin with an underscore aren't
    listed with others; those named in `unlisted` are, if they are at most `DEEPEST` folders below the root."""
    root = path.rstrip("/")
    named = [f"{root}/{'*/' * d}{name}" for name in unlisted for d in range(DEEPEST + 1)]
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    found = [p for p in named if at(p).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at(p))]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    rows = files.load(path) if not found else files.load(path).unionByName(files.load(found))
    folder, within = ride_paths(F.col("path"), path)
    return rows.select(folder.alias("ride_folder"), "path", within.alias("ride_path"), F.lower(F.regexp_extract("path", r"\.[^./]*$", 0)).alias("suffix"), "length", F.col("modificationTime").alias("modified"))


def frame_files(manifests: DataFrame, key: str = "ride_id") -> DataFrame:
    """(key, ride_sec, file): the later entry wins where two have one second."""
    rows = manifests.select(key, F.posexplode("frames").alias("pos", "f"))
    return rows.groupBy(key, F.col("f.ride_secs").alias("ride_sec")).agg(F.max_by("f.file", "pos").alias("file"))


def proxies(files: DataFrame) -> DataFrame:
    """Full-resolution files with their low-resolution file if it is there, else themselves."""
    from ..functions.scalars import proxy_name

    name = F.regexp_extract("path", r"[^/]*$", 0)
    there = files.select("ride_folder", name.alias("proxy"), F.col("path").alias("proxy_path"))
    full = files.where(name.rlike(r"^G.*\.(MP4|mp4)$")).withColumn("proxy", proxy_name(name))
    return full.join(there, ["ride_folder", "proxy"], "left").withColumn("proxy_path", F.coalesce("proxy_path", "path")).drop("proxy")
