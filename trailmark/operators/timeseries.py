"""Event detection and smoothing on time series keyed by an entity.

Windows partition by the entity key first, so that operators on one table share an exchange and a sort. Ordering is by
(time, sequence number), which is total. Timestamps carry no zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import feet, gradient, num, seconds_between


def _order(key: str, ts: str, seq: str):
    return Window.partitionBy(key).orderBy(ts, seq)


def sustained_runs(df: DataFrame, hit: Column, value: str, min_secs: float, score, reason: str, key: str = "ride_id", ts: str = "ts", seq: str = "seq", emit_open: bool = False) -> DataFrame:
    """Runs of consecutive rows where `hit` holds, of at least `min_secs` from the first row to the first failing one.

    (key, start_ts, end_ts, reason, score, peak_value, peak_ts). `score` maps the peak column to the score. A run still
    open at the end of its series is dropped unless `emit_open`, which ends it at its last row. Ties for the peak go to
    the earliest row; nulls never hit.
    """
    w = _order(key, ts, seq)
    ok = F.coalesce(hit, F.lit(False))
    rows = df.select(key, ts, seq, F.col(value).cast("double").alias("v"), ok.alias("ok"), F.lead(ts).over(w).alias("next_ts"), F.row_number().over(w).alias("rn"))
    rows = rows.withColumn("edge", (F.col("ok") & ~F.coalesce(F.lag("ok").over(w), F.lit(False))).cast("int")).withColumn("island", F.sum("edge").over(w))
    end = F.max_by("next_ts", "rn")
    runs = rows.where("ok").groupBy(key, "island").agg(
        F.min(ts).alias("start_ts"),
        (F.coalesce(end, F.max(ts)) if emit_open else end).alias("end_ts"),
        F.max("v").alias("peak_value"),
        F.max_by(ts, F.struct("v", -F.col("rn"))).alias("peak_ts"),
    )
    runs = runs.where(F.col("end_ts").isNotNull() & (seconds_between(F.col("start_ts"), F.col("end_ts")) >= min_secs))
    return runs.select(key, "start_ts", "end_ts", F.lit(reason).alias("reason"), score(F.col("peak_value")).alias("score"), "peak_value", "peak_ts")


def threshold_runs(df: DataFrame, value: str, threshold: float, min_secs: float, reason: str, cap: float | None = None, **names) -> DataFrame:
    """`sustained_runs` of values at or above a threshold; values above the cap count as missing."""
    hit = (F.col(value) >= threshold) & (F.lit(True) if cap is None else F.col(value) <= cap)
    return sustained_runs(df, hit, value, min_secs, lambda p: F.least(num(1), (p - threshold) / threshold + 0.5), reason, **names)


def sprints(df: DataFrame, power: str = "power", cadence: str = "cadence", min_power: float = 400, min_cadence: float = 100, min_secs: float = 5, **names) -> DataFrame:
    """Runs of high power and high cadence, nulls as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return sustained_runs(df, (zero(power) >= min_power) & (zero(cadence) >= min_cadence), power, min_secs, lambda p: F.least(num(1), p / 800), "sprint", **names)


def climbs(df: DataFrame, value: str = "altitude", min_gain: float = 15, window_secs: int = 120, key: str = "ride_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Every row with a value that lies at least `min_gain` above the first row of the trailing window."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts))
    t = df.select(key, ts, seq, F.col(value).cast("double").alias("v"), micros.alias("t"))
    w = Window.partitionBy(key).orderBy("t").rangeBetween(-window_secs * 1_000_000, 0)
    first = F.min_by(F.struct(F.col(ts).alias("s"), F.col("v").alias("v")), F.struct("t", seq)).over(w)
    rows = t.withColumn("first", first).withColumn("gain", F.col("v") - F.col("first.v")).where(F.col("gain") >= min_gain)
    return rows.select(key, F.col("first.s").alias("start_ts"), F.col(ts).alias("end_ts"), F.lit("climb").alias("reason"), F.least(num(1), F.col("gain") / (3 * min_gain)).alias("score"), F.col("gain").alias("peak_value"), F.col(ts).alias("peak_ts"))


def merge_intervals(df: DataFrame, gap_secs: float, key: str = "ride_id", order: tuple[str, ...] = ("start_ts", "end_ts", "reason", "score")) -> DataFrame:
    """Intervals that start at most `gap_secs` after the running end are one; its values are those of the member with
    the highest score, the first on ties. `description` names the last step of the merge, with two names for a climb and
    a speed spike. `order` must be total; the reference order is (start, detector, ordinal)."""
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("rn", F.row_number().over(w)).withColumn("reach", F.max("end_ts").over(before))
    new = F.col("reach").isNull() | (seconds_between(F.col("reach"), F.col("start_ts")) > gap_secs)
    rows = rows.withColumn("grp", F.sum(new.cast("int")).over(w))
    inside = Window.partitionBy(key, "grp").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prev", F.max_by(F.struct("reason", "peak_ts", "start_ts"), F.struct("score", -F.col("rn"))).over(inside))
    rows = rows.withColumn("prev_start", F.min("start_ts").over(inside))
    a, b = F.col("prev.reason"), F.col("reason")
    at = lambda r, other: F.coalesce(r, other)
    mine, theirs = at(F.col("peak_ts"), F.col("start_ts")), at(F.col("prev.peak_ts"), F.col("prev_start"))
    crest = F.when((F.when(b == "climb", mine).otherwise(theirs)) <= (F.when(b == "climb", theirs).otherwise(mine)), "descent over crest").otherwise("sprint into climb")
    pair = ((a == "climb") & (b == "speed_spike")) | ((a == "speed_spike") & (b == "climb"))
    rows = rows.withColumn("step", F.when(F.col("prev").isNull(), None).when(pair, crest).otherwise(F.concat(F.lit("merged: "), a, F.lit(" + "), b)))
    best = lambda c: F.max_by(c, F.struct("score", -F.col("rn"))).alias(c)
    out = rows.groupBy(key, "grp").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), best("reason"), F.max("score").alias("score"), best("peak_value"), best("peak_ts"), F.max_by("step", "rn").alias("description"), F.count(F.lit(1)).alias("n_merged"))
    return out.drop("grp")


def padded(df: DataFrame, bounds: DataFrame, before_secs: float, after_secs: float, key: str = "ride_id") -> DataFrame:
    """Intervals widened by the pads and clamped to the entity's (first_ts, last_ts)."""
    shift = lambda c, secs: F.col(c) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(secs))
    joined = df.join(bounds.select(key, "first_ts", "last_ts"), key)
    start, end = F.greatest(shift("start_ts", -before_secs), F.col("first_ts")), F.least(shift("end_ts", after_secs), F.col("last_ts"))
    return joined.withColumns({"start_ts": start, "end_ts": end}).drop("first_ts", "last_ts")


def highlights(points: DataFrame, power: float = 348, speed: float = 12, heart_rate: float = 171, key: str = "ride_id", ts: str = "ts", seq: str = "seq", gap_secs: float = 15, pad=(5.0, 10.0)) -> DataFrame:
    """All detectors, merged, padded and clamped. Power runs and sprints need a power sensor; sprints a cadence sensor."""
    names = {"key": key, "ts": ts, "seq": seq}
    has = points.groupBy(key).agg(F.bool_or(F.col("power").isNotNull()).alias("has_power"), F.bool_or(F.col("cadence").isNotNull()).alias("has_cadence"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    found = threshold_runs(points, "power", power, 10, "power_spike", 1500, **names).join(has.where("has_power").select(key), key, "left_semi")
    found = found.unionByName(threshold_runs(points, "speed", speed, 10, "speed_spike", 22, **names))
    found = found.unionByName(threshold_runs(points, "heart_rate", heart_rate, 30, "high_heart_rate", 220, **names))
    found = found.unionByName(climbs(points, **names))
    found = found.unionByName(sprints(points, **names).join(has.where("has_power and has_cadence").select(key), key, "left_semi"))
    return padded(merge_intervals(found, gap_secs, key), has, *pad, key=key)


def elevation_gain(df: DataFrame, value: str = "altitude", key: str = "ride_id", ts: str = "ts", seq: str = "seq", least_rows: int = 5) -> DataFrame:
    """(key, gain_feet): positive steps of the five-row centred mean of non-null values; 0 with few rows."""
    rows = df.where(F.col(value).isNotNull())
    w = _order(key, ts, seq)
    smooth = rows.select(key, ts, seq, F.avg(value).over(w.rowsBetween(-2, 2)).alias("m"), F.row_number().over(w).alias("rn"))
    step = smooth.withColumn("up", F.greatest(F.col("m") - F.lag("m").over(w), num(0)))
    out = step.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("up"), num(0)).alias("up"))
    return out.select(key, F.when(F.col("n") > least_rows, feet(F.col("up"))).otherwise(num(0)).alias("gain_feet"))


def point_gradient(df: DataFrame, altitude: str = "altitude", distance: str = "distance", key: str = "ride_id", ts: str = "ts", seq: str = "seq", least: float = 0.5, strict: bool = False) -> DataFrame:
    """`df` with `grade`, percent from the row before; 0 for the first row and where a value is missing."""
    w = _order(key, ts, seq)
    step = lambda c: F.col(c) - F.lag(c).over(w)
    return df.withColumn("grade", F.coalesce(gradient(step(altitude), step(distance), least, strict), num(0)))


def trimmed_lead(df: DataFrame, value: str = "altitude", key: str = "ride_id", ts: str = "ts", seq: str = "seq", limit_feet: float = 200) -> DataFrame:
    """Rows without a leading stretch that lies more than the limit from the sixth smallest of rows 2 to 11."""
    w = _order(key, ts, seq)
    rows = df.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    early = rows.where("rn between 2 and 11").groupBy(key).agg(F.element_at(F.sort_array(F.collect_list(value)), 6).alias("base"))
    rows = rows.join(early, key, "left")
    ok = (F.col("n") <= 10) | F.coalesce(F.abs(feet(F.col(value)) - feet(F.col("base"))) <= limit_feet, F.lit(True))
    return rows.withColumn("started", F.max(ok).over(w)).where("started").drop("rn", "n", "base", "started")


def heading(df: DataFrame, lat: str = "lat", lon: str = "lon", key: str = "ride_id", ts: str = "ts", seq: str = "seq", pairs: int = 10) -> DataFrame:
    """`df` with `heading`, degrees clockwise from north, over the last pairs of adjacent rows with a position."""
    w = _order(key, ts, seq)
    rows = df.withColumn("dlat", F.col(lat) - F.lag(lat).over(w)).withColumn("dlon", (F.col(lon) - F.lag(lon).over(w)) * F.cos(F.radians(lat)))
    recent = w.rowsBetween(-(pairs - 1), 0)
    angle = F.degrees(F.atan2(F.coalesce(F.sum("dlon").over(recent), num(0)), F.coalesce(F.sum("dlat").over(recent), num(0))))
    return rows.withColumn("heading", F.pmod(angle + 360, num(360))).drop("dlat", "dlon")


def lock_start(samples: DataFrame, key: str = "clip_name", idx: str = "idx", fix: str = "fix", least_fix: int = 2, run: int = 30) -> DataFrame:
    """(key, lock_idx): first index with `run` rows left of which all have a fix."""
    w = Window.partitionBy(key).orderBy(idx)
    ahead = w.rowsBetween(0, run - 1)
    rows = samples.select(key, idx, F.min(F.coalesce(F.col(fix), F.lit(-1))).over(ahead).alias("low"), F.count(F.lit(1)).over(ahead).alias("left"))
    return rows.where((F.col("low") >= least_fix) & (F.col("left") >= run)).groupBy(key).agg(F.min(idx).alias("lock_idx"))


def first_locked(samples: DataFrame, key: str = "clip_name", idx: str = "idx", fix: str = "fix", least_fix: int = 2) -> DataFrame:
    """(key, first_idx): earliest sample with a fix."""
    return samples.where(F.col(fix) >= least_fix).groupBy(key).agg(F.min(idx).alias("first_idx"))


def clock_drift(samples: DataFrame, clips: DataFrame, key: str = "clip_name", idx: str = "idx", ts: str = "ts", fix: str = "fix", hertz: float = 10.0, rows: int = 200, run: int = 30) -> DataFrame:
    """(key, drift): median over the rows after the lock (`run` rows with a fix) of sample time less nominal time."""
    locked = samples.join(lock_start(samples, key, idx, fix, run=run), key).where((F.col(idx) >= F.col("lock_idx")) & (F.col(idx) < F.col("lock_idx") + rows) & (F.col(fix) >= 2))
    joined = locked.join(clips.select(key, "creation_time"), key)
    drift = seconds_between(F.col("creation_time"), F.col(ts)) - F.col(idx) / hertz
    return joined.groupBy(key).agg(F.median(drift).alias("drift"))


def offset_consensus(drifts: DataFrame, key: str = "ride_id", drift: str = "drift", tolerance: float = 5.0) -> DataFrame:
    """(key, offset, confidence, n_kept, spread): median of the values within the tolerance of the median."""
    middle = drifts.groupBy(key).agg(F.median(drift).alias("mid"))
    kept = drifts.join(middle, key).withColumn("kept", F.when(F.abs(F.col(drift) - F.col("mid")) <= tolerance, F.col(drift)))
    out = kept.groupBy(key).agg(F.median("kept").alias("middle"), F.count("kept").alias("n_kept"), (F.max("kept") - F.min("kept")).alias("spread"), F.count(drift).alias("n"))
    sure = F.when(F.col("n") == 0, 0.0).when(F.col("n_kept") == 0, 0.4).when(F.col("n_kept") == 1, 0.85).when(F.col("spread") <= 1, 1.0).otherwise(0.7)
    return out.select(key, F.coalesce("middle", num(0)).alias("offset"), sure.alias("confidence"), "n_kept", F.coalesce("spread", num(0)).alias("spread"))


def merge_regions(times: DataFrame, pad: float, key: str = "clip_name", t: str = "t", limit: str = "duration") -> DataFrame:
    """(key, region_start, region_end): instants widened by the pad within 0..limit, overlapping ones merged."""
    rows = times.select(key, F.greatest(num(0), F.col(t) - pad).alias("a"), F.least(F.col(limit), F.col(t) + pad).alias("b"))
    w = Window.partitionBy(key).orderBy("a", "b")
    rows = rows.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")).withColumn("grp", F.sum("new").over(w))
    return rows.groupBy(key, "grp").agg(F.min("a").alias("region_start"), F.max("b").alias("region_end")).drop("grp")


def injected_times(hot: Column, forced: Column, least: float = 5.0) -> Column:
    """`hot` with each forced time, in order, that lies at least `least` from all in the growing list."""
    return F.aggregate(forced, hot, lambda have, x: F.when(F.exists(have, lambda y: F.abs(y - x) < least), have).otherwise(F.array_append(have, x)))


def coverage_times(duration: Column, step: float = 45.0, edge: float = 5.0) -> Column:
    """Every `step` seconds from min(edge, half) to max(that, duration - edge)."""
    low = F.least(num(edge), duration / 2)
    high = F.greatest(low, duration - edge)
    return F.transform(F.sequence(F.lit(0), F.floor((high - low) / step).cast("int")), lambda i: low + i * num(step))


def frame_grid(clips: DataFrame, key: str = "ride_id", clip: str = "clip_name", start: str = "clip_start", duration: str = "duration_secs", ride_secs: str = "ride_secs", step: int = 1) -> DataFrame:
    """(key, clip, video_sec, ride_sec) of whole video seconds whose ride second lies within 0..ride_secs."""
    whole = F.col(duration).cast("int")
    rows = clips.where(whole > 0).select(key, clip, start, ride_secs, F.explode(F.sequence(F.lit(0), whole - 1, F.lit(step))).alias("video_sec"))
    rows = rows.withColumn("ride_sec", (F.col(start) + F.col("video_sec")).cast("long"))
    return rows.where((F.col("ride_sec") >= 0) & (F.col("ride_sec") <= F.col(ride_secs))).select(key, clip, "video_sec", "ride_sec")


def downsampled(df: DataFrame, rows: int, key: str = "ride_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Every k-th row, k = max(1, n div rows)."""
    w = _order(key, ts, seq)
    counted = df.withColumn("rn", F.row_number().over(w) - 1).withColumn("k", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(key)) / rows)))
    return counted.where(F.col("rn") % F.col("k") == 0).drop("rn", "k")


def window_median(probes: DataFrame, points: DataFrame, value: str, half_secs: float = 3.0, key: str = "ride_id", probe_ts: str = "probe_ts", ts: str = "ts") -> DataFrame:
    """`probes` with `median_<value>` over points within the half window on both sides, inclusive; null without any."""
    from .joins import within

    uid = probes.withColumn("probe_no", F.row_number().over(Window.partitionBy(key).orderBy(probe_ts, *[c for c in probes.columns if c not in (key, probe_ts)])))
    near = within(uid.select(key, "probe_no", F.col(probe_ts).alias("at")), points.select(key, ts, value).where(F.col(value).isNotNull()), half_secs, key, "at", ts)
    return uid.join(near.groupBy(key, "probe_no").agg(F.median(value).alias(f"median_{value}")), [key, "probe_no"], "left").drop("probe_no")


