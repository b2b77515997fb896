"""Summaries of series, clips, candidates, files and pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import feet, gradient, miles, mph, num
from .joins import asof_nearest
from .timeseries import elevation_gain


def series_summary(points: DataFrame, metrics: list[str], key: str = "ride_id") -> DataFrame:
    """Rows, and average and maximum of each metric over non-null values, zeros included."""
    aggs = [f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("avg", F.avg), ("max", F.max))]
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("n_points"), *aggs)


def ride_stats(points: DataFrame, sessions: DataFrame, key: str = "ride_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Recap numbers: session totals where not null or 0, else from points; average power over non-zero rows."""
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    own = points.groupBy(key).agg(F.max("distance").alias("p_distance"), F.max("speed").alias("p_max"), F.avg(nonzero("speed")).alias("p_avg"), F.avg(nonzero("power")).alias("avg_power"), F.count(F.lit(1)).alias("p_secs"), F.min(ts).alias("first_ts"), F.array_sort(F.collect_list(F.when(F.col("lat").isNotNull(), F.struct(seq, "lat", "lon")))).alias("route"))
    rows = own.join(sessions, key, "left").join(elevation_gain(points, key=key, ts=ts, seq=seq), key, "left")
    pick = lambda c, other: F.coalesce(nonzero(c), F.col(other), num(0))
    return rows.select(key, miles(pick("total_distance", "p_distance")).alias("distance_mi"), pick("total_timer_time", "p_secs").alias("moving_secs"), mph(pick("max_speed", "p_max")).alias("top_mph"), mph(pick("avg_speed", "p_avg")).alias("avg_mph"), "avg_power", F.coalesce("gain_feet", num(0)).alias("gain_feet"), F.to_date("first_ts").alias("ride_date"), F.transform("route", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("route"))


def profile(points: DataFrame, key: str = "ride_id", seq: str = "seq", rows: int = 1000) -> DataFrame:
    """Elevation profile (miles, feet) of at most about `rows` points in order, total miles, and bounds of the route."""
    from .timeseries import downsampled

    thin = downsampled(points.where("altitude is not null and distance is not null"), rows, key, seq, seq)
    line = thin.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, miles(F.col("distance")).alias("mi"), feet(F.col("altitude")).alias("ft")))), lambda p: F.struct(p["mi"].alias("mi"), p["ft"].alias("ft"))).alias("profile"))
    ends = points.groupBy(key).agg(miles(F.max("distance")).alias("total_mi"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    return ends.join(line, key, "left")


def gauge_ranges(points: DataFrame, key: str = "ride_id") -> DataFrame:
    """Largest non-zero speed, power, heart rate and cadence, with defaults; bounds and middle latitude of the route."""
    top = lambda c, default, f=lambda x: x: F.coalesce(f(F.max(F.when(F.col(c) != 0, F.col(c)))), F.lit(default)).alias(f"top_{c}")
    box = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy(key).agg(top("speed", 40.0, mph), top("power", 500), top("heart_rate", 200), top("cadence", 120), *box, ((F.min("lat") + F.max("lat")) / 2).alias("mid_lat"))


def clip_samples(clips: DataFrame, key: str | list[str] = "clip_name", start: str = "start_secs", length: str = "length_secs") -> DataFrame:
    """(key, sample_no, at): instants every max(0.5, length / 8) seconds from the start, up to nine."""
    keys = [key] if isinstance(key, str) else key
    step = F.greatest(num(0.5), F.col(length) / 8)
    grid = F.explode(F.sequence(F.lit(0), F.least(F.lit(8), F.floor(F.col(length) / step).cast("int"))))
    return clips.select(*keys, F.col(start).alias("s"), step.alias("step"), grid.alias("sample_no")).select(*keys, "sample_no", (F.col("s") + F.col("sample_no") * F.col("step")).alias("at"))


def sample_points(samples: DataFrame, points: DataFrame, base: DataFrame, back_secs: float = 5.0, key: str = "ride_id") -> DataFrame:
    """Samples (key, ..., at in seconds from `base`'s t0) with the nearest point's speed, power and heart rate, and `grade` from
    the point nearest to `back_secs` before, not before 0; samples whose point has no speed are left out."""
    at = lambda x: F.col("t0") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(x, 6).cast("decimal(18,6)"))
    rows = samples.join(base.select(key, "t0").hint("shuffle_hash"), key)  # one row for each entity; spares a sort of all samples
    now = rows.withColumn("probe_ts", at(F.col("at")))
    now = asof_nearest(now, points, ["seq", "speed", "power", "heart_rate", "altitude", "distance"], key=key).drop("asof_ts", "asof_gap")
    then = now.withColumn("probe_ts", at(F.greatest(num(0), F.col("at") - back_secs)))
    before = points.select(key, "ts", "seq", F.col("altitude").alias("alt0"), F.col("distance").alias("dist0"))
    both = asof_nearest(then.drop("seq", "t0"), before, ["seq", "alt0", "dist0"], key=key).where("speed is not null")
    rise, run = F.col("altitude") - F.col("alt0"), F.col("distance") - F.col("dist0")
    grade = F.when(rise.isNotNull() & run.isNotNull(), F.coalesce(gradient(rise, run), num(0)))
    return both.withColumn("grade", grade)


def sample_summary(samples: DataFrame, metrics: list[str], grade: str = "grade", key: str | list[str] = "clip_name") -> DataFrame:
    """Samples, average and peak of each metric over a clip's, the mean gradient and the steepest one, with its sign: the highest or
    the lowest. (As plain numbers, so that samples aren't sorted by clip.)"""
    keys = [key] if isinstance(key, str) else key
    aggs = [f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("avg", F.avg), ("peak", F.max))]
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), *aggs, F.avg(grade).alias("avg_grade"), F.when(F.max(grade) >= -F.min(grade), F.max(grade)).otherwise(F.min(grade)).alias("peak_grade"))


def telemetry_block(frames: DataFrame, found: DataFrame, powered: DataFrame, batch: list[str], frame: str = "frame", key: str = "ride_id") -> DataFrame:
    """(batch, block): a text about each batch's frames, numbered in their order: a line with mean speed (and power) of those
    that have a speed, then one for each frame with its speed in mph, power in watts, heart rate and gradient, or without data.

    `frames` has the batch's columns and `frame`; `found` those of `sample_points` beside them; `powered` (key, has_power) tells of
    each entity whether power is told. Lines are put in order within the aggregate, whose group is one batch.
    """
    whole = lambda x: F.bround(x, 0).cast("long").cast("string")
    grade = F.coalesce("grade", num(0))
    steep = F.concat(F.when(grade < 0, "-").otherwise("+"), whole(F.abs(grade)), F.lit("%"))
    rows = frames.select(*batch, frame).join(found.select(*batch, frame, "speed", "power", "heart_rate", "grade"), [*batch, frame], "left").join(powered.select(key, "has_power"), key, "left")
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy(*batch).orderBy(frame)) - 1)
    watts = F.when(F.col("has_power"), F.coalesce("power", F.lit(0)))
    told = F.concat_ws(" ", F.concat(whole(mph(F.col("speed"))), F.lit("mph")), F.concat(watts.cast("string"), F.lit("W")), F.concat(F.coalesce("heart_rate", F.lit(0)).cast("string"), F.lit("bpm")), steep)
    line = F.concat(F.lit("Frame "), F.col("number").cast("string"), F.lit(": "), F.when(F.col("speed").isNotNull(), told).otherwise("no data"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"]), "\n")
    known = F.col("speed").isNotNull()
    mean = F.concat_ws(" ", F.concat(F.lit("Baseline: avg "), whole(F.avg(F.when(known, mph(F.col("speed"))))), F.lit("mph")), F.concat(whole(F.avg(F.when(known, watts))), F.lit("W")))
    rows = rows.groupBy(*batch).agg(text.alias("lines"), F.when(F.count(F.when(known, 1)) > 0, F.concat(mean, F.lit("\n"))).otherwise("").alias("head"))
    return rows.select(*batch, F.concat("head", "lines").alias("block"))


def text_lines(rows: DataFrame, line: Column, key: str, order: list[str], limit: int | None = None, name: str = "digest") -> DataFrame:
    """(key, digest, n): lines in order; beyond the limit, one line tells how many more there are."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.select(key, line.alias("line"), F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    kept = numbered if limit is None else numbered.where(F.col("rn") <= limit)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "\n")
    out = kept.groupBy(key).agg(text.alias(name), F.first("n").alias("n"))
    if limit is None:
        return out
    more = F.when(F.col("n") > limit, F.concat(F.lit("\n... "), (F.col("n") - limit).cast("string"), F.lit(" more"))).otherwise("")
    return out.withColumn(name, F.concat(F.col(name), more))


def score_ranges(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Population standard deviation, minimum and maximum of each metric."""
    aggs = [f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("sd", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)


# Fixed values of the shot measure: weights of luma; percentiles of black and white; least range; tones that count as middle;
# spread below which a pixel is neutral, and how many of these a frame needs; bounds of gains; what a frame without middle tones has.
LUMA = (0.2126, 0.7152, 0.0722)
LEVELS = (0.005, 0.997)
LEAST_RANGE = 0.05
MIDDLE = (0.15, 0.85)
CHROMA, LEAST_NEUTRAL = 0.12, 500
GAINS = (0.93, 1.07)
LEAST_MEAN, LEAST_LUMA, FLAT_LUMA = 1e-4, 0.05, 0.35
# Fixed values of the exposure change: the luma it aims for, the part of the way that it goes, its bound in stops.
TARGET, DAMP, MOST_EV = 0.40, 0.6, 0.6


def shot_balance(pixels: DataFrame, key: str = "shot_id", frame: str = "frame", least: int = LEAST_NEUTRAL) -> DataFrame:
    """(key, black, white, gain_r, gain_b, ev, median_luma): medians over a shot's frames of its levels, of the gains that make
    its neutral middle tones grey, and of the luma after both; and the damped, bounded exposure change towards the target.

    A frame with few neutral pixels is balanced on all its middle tones; one without any has gains of 1 and a fixed luma.
    Levels are joined back to a frame's pixels twice, an equi-join on (key, frame).
    """
    clip = lambda x, low, high: F.greatest(num(low), F.least(num(high), x))
    luma = lambda r, g, b: LUMA[0] * r + LUMA[1] * g + LUMA[2] * b
    rgb = [F.col(c) for c in "rgb"]
    rows = pixels.select(key, frame, *rgb, luma(*rgb).alias("y"))
    ends = rows.groupBy(key, frame).agg(F.percentile("y", F.lit(LEVELS[0])).alias("lo"), F.percentile("y", F.lit(LEVELS[1])).alias("top"))
    ends = ends.select(key, frame, "lo", F.greatest(F.col("top"), F.col("lo") + LEAST_RANGE).alias("hi"))
    level = rows.join(ends, [key, frame]).select(key, frame, "lo", "hi", *[clip((x - F.col("lo")) / (F.col("hi") - F.col("lo")), 0, 1).alias(c) for c, x in zip("rgb", rgb, strict=True)])
    y = luma(*rgb)
    middle = (y > MIDDLE[0]) & (y < MIDDLE[1])
    neutral = middle & (F.greatest(*rgb) - F.least(*rgb) < CHROMA)
    means = [F.avg(F.when(m, F.col(c))).alias(f"{c}_{name}") for c in "rgb" for name, m in (("neutral", neutral), ("middle", middle))]
    frames = level.groupBy(key, frame).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count(F.when(neutral, 1)).alias("n_neutral"), F.count(F.when(middle, 1)).alias("n_middle"), *means)
    mean = lambda c: F.when(F.col("n_neutral") >= least, F.col(f"{c}_neutral")).otherwise(F.col(f"{c}_middle"))
    gain = lambda c: F.when(F.col("n_middle") > 0, clip(mean("g") / F.greatest(mean(c), num(LEAST_MEAN)), *GAINS)).otherwise(num(1))
    frames = frames.select(key, frame, "lo", "hi", "n_middle", gain("r").alias("gain_r"), gain("b").alias("gain_b"))
    seen = level.join(frames.select(key, frame, "gain_r", "gain_b"), [key, frame])
    mid = seen.groupBy(key, frame).agg(F.median(luma(clip(F.col("r") * F.col("gain_r"), 0, 1), F.col("g"), clip(F.col("b") * F.col("gain_b"), 0, 1))).alias("mid"))
    frames = frames.join(mid, [key, frame]).withColumn("mid", F.when(F.col("n_middle") > 0, F.col("mid")).otherwise(num(FLAT_LUMA)))
    names = {"lo": "black", "hi": "white", "gain_r": "gain_r", "gain_b": "gain_b", "mid": "median_luma"}
    shots = frames.groupBy(key).agg(*[F.median(c).alias(name) for c, name in names.items()])
    stops = clip(DAMP * F.log2(TARGET / F.greatest(F.col("median_luma"), num(LEAST_LUMA))), -MOST_EV, MOST_EV)
    rounded = {name: F.round(name, 4) for name in names.values()}
    return shots.withColumn("ev", F.round(stops, 3)).withColumns(rounded)


# What a ride folder can do without.
RAW_SUFFIXES = (".mp4", ".lrv", ".thm")
RAW_FOLDERS = ("frames", "_work")


def retention(files: DataFrame, cutoff: Column, key: str = "ride_folder", path: str = "path") -> DataFrame:
    """Per ride folder: raw files, raw folders and the bytes of both, whether it has highlights, and why it is skipped (null:
    free it). Reports only. `files` has the folder, each file's `path` within it (`ride_path` of an inventory), `suffix` and
    `length`; a folder is named by its date, and one of a later day than the cutoff is recent."""
    day = F.try_to_date(F.regexp_extract(key, r"(?:^|/)(\d{4}-\d{2}-\d{2})$", 1), "yyyy-MM-dd")
    top = F.regexp_extract(path, "^([^/]*)/", 1)
    raw = (top == "") & F.lower("suffix").isin(*RAW_SUFFIXES)
    within = top.isin(*RAW_FOLDERS)
    shown = (top == "highlights") & F.col(path).rlike(r"^highlights/[^/]*\.mp4$")
    length = lambda m: F.coalesce(F.sum(F.when(m, F.col("length"))), F.lit(0))
    rows = files.groupBy(key).agg(F.count(F.when(raw, 1)).alias("raw_files"), F.count_distinct(F.when(within, top)).alias("raw_folders"), length(raw | within).alias("raw_bytes"), F.bool_or(shown).alias("has_highlights"))
    clean = (F.col("raw_files") == 0) & (F.col("raw_folders") == 0)
    why = F.when(day.isNull(), "no date").when(day > cutoff, "recent").when(~F.col("has_highlights"), "no highlights").when(clean, "nothing to free")
    return rows.withColumn("ride_date", day).withColumn("skip_reason", why)


#: Widths of time buckets are powers of this, in seconds.
WIDER = 8


def clip_payload(clips: DataFrame, points: DataFrame, margin: float = 1.0, key: str = "ride_id", start: str = "clip_start", end: str = "clip_end", at: str = "at_secs") -> DataFrame:
    """Each clip with the points from `margin` seconds before it to as many after, and `video_secs` of each, to a tenth. An
    equi-join on (key, width, time bucket): a clip stands in two buckets at most, of the least power of `WIDER` seconds that is no
    shorter than it; a point stands in one bucket of each width that a clip has, which are some ten."""
    low, high = F.col(start) - margin, F.col(end) + margin
    width = F.pow(num(WIDER), F.ceil(F.log(F.greatest(num(1), high - low)) / math.log(WIDER)).cast("double"))
    bucket = lambda x: F.floor(x / F.col("width"))
    left = clips.where(low <= high).withColumn("width", width)
    widths = left.select("width").distinct()
    left = left.withColumn("bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    right = points.crossJoin(F.broadcast(widths)).withColumn("bucket", bucket(F.col(at)))
    pairs = left.join(right, [key, "width", "bucket"]).where(F.col(at).between(low, high))
    return pairs.drop("width", "bucket").withColumn("video_secs", F.round(F.col(at) - F.col(start), 1))


def reviewer_counts(candidates: DataFrame, key: str = "ride_id") -> DataFrame:
    """Candidates, selected, rated, and how many have each source."""
    rows = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("selected")).alias("n_selected"), F.count_if(F.col("rating") > 0).alias("n_rated"))
    mix = candidates.select(key, F.explode("sources").alias("source")).groupBy(key, "source").agg(F.count(F.lit(1)).alias("n_source"))
    return rows.join(mix, key, "left")
