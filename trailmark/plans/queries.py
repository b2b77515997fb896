"""One query for each operator or small family of operators, and its SQL where SQL expresses it.

Time bounds are scaled to hours, as users' events are hours apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import aggregates, candidates, evaluate, geo, joins, ranker, scoring, selection, timeseries
from ..sources import readers
from .tables import points, table, with_points

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_points(sql)
        return f

    return add


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


HOUR = 3600.0

# --- time series ----------------------------------------------------------------------------------------------------

RUNS = """
  m AS (SELECT ride_id, ts, seq, value, coalesce(value >= 40, false) AS ok, lead(ts) OVER w AS next_ts, row_number() OVER w AS rn FROM points WINDOW w AS (PARTITION BY ride_id ORDER BY ts, seq)),
  e AS (SELECT *, (ok AND NOT coalesce(lag(ok) OVER w, false))::INT AS edge FROM m WINDOW w AS (PARTITION BY ride_id ORDER BY rn)),
  i AS (SELECT *, sum(edge) OVER (PARTITION BY ride_id ORDER BY rn) AS island FROM e),
  runs AS (SELECT ride_id, min(ts) AS start_ts, arg_max_null(next_ts, rn) AS end_ts, max(value) AS peak_value, arg_max(ts, (value, -rn)) AS peak_ts FROM i WHERE ok GROUP BY ride_id, island),
  found AS (SELECT ride_id, start_ts, end_ts, 'speed_spike' AS reason, least(1.0, (peak_value - 40) / 40 + 0.5) AS score, peak_value, peak_ts FROM runs WHERE epoch_us(end_ts) - epoch_us(start_ts) >= 21600000000)"""
CLIMBS = """
  c0 AS (SELECT ride_id, ts, seq, altitude AS v, first_value(ts) OVER w AS s_ts, first_value(altitude) OVER w AS s_v FROM points
    WINDOW w AS (PARTITION BY ride_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)),
  climbs AS (SELECT ride_id, s_ts AS start_ts, ts AS end_ts, 'climb' AS reason, least(1.0, (v - s_v) / 300) AS score, v - s_v AS peak_value, ts AS peak_ts FROM c0 WHERE v - s_v >= 100)"""
MERGED = """
  o AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY start_ts, end_ts, reason, score) AS rn FROM hl),
  r AS (SELECT *, max(end_ts) OVER (PARTITION BY ride_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
  g AS (SELECT *, sum((reach IS NULL OR epoch_us(start_ts) - epoch_us(reach) > 7200000000)::INT) OVER (PARTITION BY ride_id ORDER BY rn) AS grp FROM r),
  merged AS (SELECT ride_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts, arg_max(reason, (score, -rn)) AS reason, max(score) AS score, arg_max(peak_value, (score, -rn)) AS peak_value, arg_max(peak_ts, (score, -rn)) AS peak_ts, count(*) AS n_merged FROM g GROUP BY ride_id, grp)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.threshold_runs(points(spark, d), "value", 40, 6 * HOUR, "speed_spike")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    climbs = timeseries.climbs(points(spark, d), "altitude", 100, 86400)
    return timeseries.merge_intervals(_runs(spark, d).unionByName(climbs), 2 * HOUR)


@query(RUNS + ", hl AS (SELECT * FROM found)," + MERGED + "SELECT ride_id, count(*) AS n, round(max(score), 6) AS best, round(sum(epoch_us(end_ts) - epoch_us(start_ts)) / 1e6, 3) AS total_secs FROM merged GROUP BY ride_id")
def highlights_per_ride(spark, d):
    """Runs, merged, per ride: the flagship."""
    found = timeseries.merge_intervals(_runs(spark, d), 2 * HOUR)
    secs = F.round(F.sum(s.seconds_between(F.col("start_ts"), F.col("end_ts"))), 3)
    return found.groupBy("ride_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"), secs.alias("total_secs"))


@query(RUNS + "SELECT ride_id, start_ts, end_ts, reason, round(score, 6) AS score, peak_value, peak_ts FROM found")
def ts1_sustained_runs(spark, d):
    return rounded(_runs(spark, d), 6, "score")


@query(CLIMBS + "SELECT ride_id, start_ts, end_ts, reason, round(score, 6) AS score, peak_value, peak_ts FROM climbs")
def ts2_climbs(spark, d):
    return rounded(timeseries.climbs(points(spark, d), "altitude", 100, 86400), 6, "score")


@query("""
  m AS (SELECT ride_id, ts, seq, power, coalesce(power, 0) >= 300 AND coalesce(cadence, 0) >= 80 AS ok, lead(ts) OVER w AS next_ts, row_number() OVER w AS rn FROM points WINDOW w AS (PARTITION BY ride_id ORDER BY ts, seq)),
  i AS (SELECT *, rn - row_number() OVER (PARTITION BY ride_id, ok ORDER BY rn) AS island FROM m),
  runs AS (SELECT ride_id, min(ts) AS start_ts, arg_max_null(next_ts, rn) AS end_ts, max(power)::DOUBLE AS peak_value, arg_max(ts, (power, -rn)) AS peak_ts FROM i WHERE ok GROUP BY ride_id, island)
  SELECT ride_id, start_ts, end_ts, 'sprint' AS reason, least(1.0, peak_value / 800)::DOUBLE AS score, peak_value, peak_ts FROM runs WHERE epoch_us(end_ts) - epoch_us(start_ts) >= 3600000000""")
def ts3_sprints(spark, d):
    return timeseries.sprints(points(spark, d), min_power=300, min_cadence=80, min_secs=HOUR)


def _told_sql(gap_micros: int) -> str:
    """Intervals of `hl` merged, with what the last step of a merge is called."""
    return MERGED.replace("7200000000", str(gap_micros)) + """,
  before_ AS (SELECT *, arg_max(struct_pack(reason, peak_ts, start_ts), (score, -rn)) OVER w AS prev, min(start_ts) OVER w AS prev_start FROM g WINDOW w AS (PARTITION BY ride_id, grp ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  step_ AS (SELECT ride_id, grp, rn, CASE WHEN prev IS NULL THEN NULL
      WHEN prev.reason = 'climb' AND reason = 'speed_spike' THEN CASE WHEN coalesce(prev.peak_ts, prev_start) <= coalesce(peak_ts, start_ts) THEN 'descent over crest' ELSE 'sprint into climb' END
      WHEN prev.reason = 'speed_spike' AND reason = 'climb' THEN CASE WHEN coalesce(peak_ts, start_ts) <= coalesce(prev.peak_ts, prev_start) THEN 'descent over crest' ELSE 'sprint into climb' END
      ELSE 'merged: ' || prev.reason || ' + ' || reason END AS step FROM before_),
  named AS (SELECT ride_id, grp, arg_max_null(step, rn) AS description FROM step_ GROUP BY ALL),
  told AS (SELECT ride_id, grp, min(start_ts) AS start_ts, max(end_ts) AS end_ts, arg_max(reason, (score, -rn)) AS reason, max(score) AS score, arg_max(peak_value, (score, -rn)) AS peak_value, arg_max(peak_ts, (score, -rn)) AS peak_ts, count(*) AS n_merged, any_value(description) AS description FROM g JOIN named USING (ride_id, grp) GROUP BY ride_id, grp)"""


@query(RUNS + "," + CLIMBS + ", hl AS (SELECT * FROM found UNION ALL SELECT * FROM climbs)," + _told_sql(7_200_000_000) + "SELECT ride_id, start_ts, end_ts, reason, round(score, 6) AS score, peak_value, peak_ts, n_merged, description FROM told")
def ts5_merged_intervals(spark, d):
    return rounded(_merged(spark, d), 6, "score")


@query("""
  b AS (SELECT ride_id, min(ts) AS first_ts, max(ts) AS last_ts FROM points GROUP BY ride_id),""" + RUNS + """
  SELECT ride_id, greatest(start_ts - INTERVAL 5 HOUR, first_ts) AS start_ts, least(end_ts + INTERVAL 10 HOUR, last_ts) AS end_ts, round(score, 6) AS score FROM found JOIN b USING (ride_id)""")
def ts4_padded(spark, d):
    bounds = points(spark, d).groupBy("ride_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return rounded(timeseries.padded(_runs(spark, d), bounds, 5 * HOUR, 10 * HOUR).select("ride_id", "start_ts", "end_ts", "score"), 6, "score")


def _detector_sql(name: str, value: str, hit: str, secs: int, score: str) -> str:
    """A table `name` of runs of rows where `hit` holds."""
    return f"""
  {name}_m AS (SELECT ride_id, ts, seq, {value}::DOUBLE AS v, coalesce({hit}, false) AS ok, lead(ts) OVER w AS next_ts, row_number() OVER w AS rn FROM points WINDOW w AS (PARTITION BY ride_id ORDER BY ts, seq)),
  {name}_i AS (SELECT *, rn - row_number() OVER (PARTITION BY ride_id, ok ORDER BY rn) AS island FROM {name}_m),
  {name}_r AS (SELECT ride_id, min(ts) AS start_ts, arg_max_null(next_ts, rn) AS end_ts, max(v) AS peak_value, arg_max(ts, (v, -rn)) AS peak_ts FROM {name}_i WHERE ok GROUP BY ride_id, island),
  {name} AS (SELECT ride_id, start_ts, end_ts, '{name}' AS reason, {score}::DOUBLE AS score, peak_value, peak_ts FROM {name}_r WHERE epoch_us(end_ts) - epoch_us(start_ts) >= {secs}000000)"""


def _spike_sql(name: str, value: str, low: int, high: int, secs: int) -> str:
    return _detector_sql(name, value, f"{value} BETWEEN {low} AND {high}", secs, f"least(1, (peak_value - {low}) / {low} + 0.5)")


@query(_spike_sql("power_spike", "power", 348, 1500, 10) + "," + _spike_sql("speed_spike", "speed", 12, 22, 10) + "," + _spike_sql("high_heart_rate", "heart_rate", 171, 220, 30) + "," + _detector_sql("sprint", "power", "coalesce(power, 0) >= 400 AND coalesce(cadence, 0) >= 100", 5, "least(1, peak_value / 800)") + """,
  c0 AS (SELECT ride_id, ts, altitude AS v, first_value(ts) OVER w AS s_ts, first_value(altitude) OVER w AS s_v FROM points WINDOW w AS (PARTITION BY ride_id ORDER BY ts RANGE BETWEEN INTERVAL 2 MINUTE PRECEDING AND CURRENT ROW)),
  climb AS (SELECT ride_id, s_ts AS start_ts, ts AS end_ts, 'climb' AS reason, least(1.0, (v - s_v) / 45) AS score, v - s_v AS peak_value, ts AS peak_ts FROM c0 WHERE v - s_v >= 15),
  hl AS (SELECT * FROM power_spike UNION ALL SELECT * FROM speed_spike UNION ALL SELECT * FROM high_heart_rate UNION ALL SELECT * FROM climb UNION ALL SELECT * FROM sprint),""" + _told_sql(15_000_000) + """,
  bounds AS (SELECT ride_id, min(ts) AS first_ts, max(ts) AS last_ts FROM points GROUP BY ride_id)
  SELECT ride_id, greatest(start_ts - INTERVAL 5 SECOND, first_ts) AS start_ts, least(end_ts + INTERVAL 10 SECOND, last_ts) AS end_ts, reason, round(score, 6) AS score, peak_value, peak_ts, n_merged, description FROM told JOIN bounds USING (ride_id)""")
def ts6_highlights(spark, d):
    """All detectors with their gates, merged, padded and clamped."""
    return rounded(timeseries.highlights(points(spark, d), 348, 12, 171), 6, "score")


@query("""
  a AS (SELECT ride_id, seq, ts FROM points WHERE event_type = 'click'),
  n AS (SELECT a.ride_id, a.seq, median(p.value) AS m FROM a JOIN points p ON a.ride_id = p.ride_id AND abs(epoch_us(a.ts) - epoch_us(p.ts)) <= 86400000000 GROUP BY ALL)
  SELECT ride_id, seq, round(m, 6) AS median_value FROM a LEFT JOIN n USING (ride_id, seq)""")
def ts7_window_median(spark, d):
    p = points(spark, d)
    probes = p.where("event_type = 'click'").select("ride_id", "seq", F.col("ts").alias("probe_ts"))
    return rounded(timeseries.window_median(probes, p, "value", 86400.0), 6, "median_value").select("ride_id", "seq", "median_value")


@query("""
  a AS (SELECT ride_id, seq, ts, CASE event_type WHEN 'view' THEN 'label' ELSE 'telemetry' END AS source, value / 5 AS score FROM points WHERE event_type IN ('click', 'view')),
  n AS (SELECT a.ride_id, a.seq, median(p.speed) AS sp, median(p.power) AS po FROM a JOIN points p ON a.ride_id = p.ride_id AND abs(epoch_us(a.ts) - epoch_us(p.ts)) <= 86400000000 GROUP BY ALL),
  pen AS (SELECT a.*, sp, CASE WHEN source = 'label' OR sp IS NULL OR po IS NULL THEN 0 ELSE 4 * greatest(0, least(1, (14 - sp * 2.23694) / 6)) * greatest(0, least(1, (130 - po) / 100)) END AS p FROM a LEFT JOIN n USING (ride_id, seq))
  SELECT ride_id, seq, source, round(CASE WHEN p > 0.01 THEN score - p ELSE score END, 6) AS score FROM pen WHERE sp * 2.23694 >= 5""")
def ts8_ts9_liveness_and_motion_gate(spark, d):
    p = points(spark, d)
    rows = p.where("event_type in ('click', 'view')").select("ride_id", "seq", F.col("ts").alias("probe_ts"), F.when(F.col("event_type") == "view", "label").otherwise("telemetry").alias("source"), (F.col("value") / 5).alias("score"))
    rows = timeseries.window_median(timeseries.window_median(rows, p, "speed", 86400.0), p, "power", 86400.0)
    rows = rows.withColumn("must_include", F.lit(False)).withColumn("sources", F.array("source"))
    kept = candidates.moving(rows, s.mph(F.col("median_speed")))
    out = candidates.damped(kept, F.col("median_speed"), F.col("median_power"), F.lit(True))
    return rounded(out, 6, "score").select("ride_id", "seq", "source", "score")


@query("""
  a AS (SELECT ride_id, ts, seq, avg(altitude) OVER (PARTITION BY ride_id ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM points WHERE altitude IS NOT NULL),
  u AS (SELECT ride_id, greatest(m - lag(m) OVER (PARTITION BY ride_id ORDER BY ts, seq), 0) AS up FROM a)
  SELECT ride_id, round(CASE WHEN count(*) > 5 THEN coalesce(sum(up), 0) * 3.28084 ELSE 0 END, 6) AS gain_feet FROM u GROUP BY ride_id""")
def ts10_elevation_gain(spark, d):
    return rounded(timeseries.elevation_gain(points(spark, d)), 6, "gain_feet")


@query("""
  a AS (SELECT ride_id, seq, altitude - lag(altitude) OVER w AS da, distance - lag(distance) OVER w AS dd FROM points WINDOW w AS (PARTITION BY ride_id ORDER BY ts, seq))
  SELECT ride_id, seq, round(coalesce(CASE WHEN dd < 0.5 THEN 0 ELSE da / dd * 100 END, 0), 6) AS grade FROM a""")
def ts11_point_gradient(spark, d):
    return rounded(timeseries.point_gradient(points(spark, d)), 6, "grade").select("ride_id", "seq", "grade")


@query("""
  a AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY ts, seq) AS rn, count(*) OVER (PARTITION BY ride_id) AS n FROM points WHERE altitude IS NOT NULL),
  b AS (SELECT ride_id, list_sort(list(altitude))[6] AS base FROM a WHERE rn BETWEEN 2 AND 11 GROUP BY ride_id),
  c AS (SELECT a.ride_id, seq, rn, n <= 10 OR coalesce(abs(altitude * 3.28084 - base * 3.28084) <= 200, true) AS ok FROM a LEFT JOIN b USING (ride_id))
  SELECT ride_id, seq FROM (SELECT *, max(ok) OVER (PARTITION BY ride_id ORDER BY rn) AS started FROM c) WHERE started""")
def ts12_trimmed_lead(spark, d):
    return timeseries.trimmed_lead(points(spark, d).where("altitude is not null")).select("ride_id", "seq")


@query("""
  a AS (SELECT ride_id, ts, seq, lat - lag(lat) OVER w AS dlat, (lon - lag(lon) OVER w) * cos(radians(lat)) AS dlon FROM points WINDOW w AS (PARTITION BY ride_id ORDER BY ts, seq)),
  b AS (SELECT ride_id, seq, coalesce(sum(dlat) OVER w, 0) AS y, coalesce(sum(dlon) OVER w, 0) AS x FROM a WINDOW w AS (PARTITION BY ride_id ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT ride_id, seq, CASE WHEN abs(x) + abs(y) > 0.0005 THEN round((degrees(atan2(round(x, 9), round(y, 9))) + 360) % 360, 2) END AS heading FROM b""")
def ts13_heading(spark, d):
    p = points(spark, d)
    w = Window.partitionBy("ride_id").orderBy("ts", "seq")
    step = p.withColumn("dlat", F.col("lat") - F.lag("lat").over(w)).withColumn("dlon", (F.col("lon") - F.lag("lon").over(w)) * F.cos(F.radians("lat")))
    recent = w.rowsBetween(-9, 0)
    far = step.withColumn("far", F.abs(F.coalesce(F.sum("dlat").over(recent), F.lit(0.0))) + F.abs(F.coalesce(F.sum("dlon").over(recent), F.lit(0.0)))).select("ride_id", "seq", "far")
    told = rounded(timeseries.heading(p), 2, "heading").select("ride_id", "seq", "heading").join(far, ["ride_id", "seq"])
    return told.select("ride_id", "seq", F.when(F.col("far") > 0.0005, F.col("heading")).alias("heading"))  # of no movement there is no heading


SAMPLES = """
  samples AS (SELECT ride_id AS clip_name, row_number() OVER (PARTITION BY ride_id ORDER BY ts, seq) - 1 AS idx, ts, CAST(seq % 9 AS INT) AS fix FROM points),
  look AS (SELECT clip_name, idx, min(fix) OVER w AS low, count(*) OVER w AS n FROM samples WINDOW w AS (PARTITION BY clip_name ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
  lock_at AS (SELECT clip_name, min(idx) AS lock_idx FROM look WHERE low >= 2 AND n >= 3 GROUP BY clip_name),
  drifts AS (SELECT s.clip_name, median((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 - idx / 10.0) AS drift FROM samples s JOIN lock_at USING (clip_name) WHERE idx >= lock_idx AND idx < lock_idx + 200 AND fix >= 2 GROUP BY s.clip_name)"""


def _samples(spark, d):
    w = Window.partitionBy("ride_id").orderBy("ts", "seq")
    return points(spark, d).select(F.col("ride_id").alias("clip_name"), (F.row_number().over(w) - 1).cast("long").alias("idx"), "ts", (F.col("seq") % 9).cast("int").alias("fix"))


@query(SAMPLES + ", f AS (SELECT clip_name, min(idx) AS first_idx FROM samples WHERE fix >= 2 GROUP BY clip_name) SELECT clip_name, lock_idx, first_idx FROM f LEFT JOIN lock_at USING (clip_name)")
def ts14_ts22_lock(spark, d):
    samples = _samples(spark, d)
    return timeseries.first_locked(samples).join(timeseries.lock_start(samples, run=3), "clip_name", "left").select("clip_name", "lock_idx", "first_idx")


@query(SAMPLES + """,
  g AS (SELECT clip_name % 10 AS ride_id, drift % 100000 / 10000 AS drift FROM drifts),
  m AS (SELECT ride_id, median(drift) AS mid FROM g GROUP BY ride_id),
  k AS (SELECT g.ride_id, CASE WHEN abs(drift - mid) <= 5 THEN drift END AS kept FROM g JOIN m USING (ride_id)),
  a AS (SELECT ride_id, median(kept) AS o, count(kept) AS n_kept, max(kept) - min(kept) AS sp, count(*) AS n FROM k GROUP BY ride_id)
  SELECT ride_id, round(coalesce(o, 0), 6) AS offset_secs, (CASE WHEN n_kept = 0 THEN 0.4 WHEN n_kept = 1 THEN 0.85 WHEN sp <= 1 THEN 1.0 ELSE 0.7 END)::DOUBLE AS confidence, n_kept, round(coalesce(sp, 0), 6) AS spread FROM a""")
def ts15_ts16_clock_offset(spark, d):
    samples = _samples(spark, d)
    clips = samples.select("clip_name").distinct().withColumn("creation_time", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    drifts = timeseries.clock_drift(samples, clips, run=3)
    scaled = drifts.select((F.col("clip_name") % 10).alias("ride_id"), (F.col("drift") % 100000 / 10000).alias("drift"))
    return rounded(timeseries.offset_consensus(scaled), 6, "offset", "spread").withColumnRenamed("offset", "offset_secs")


@query("""
  a AS (SELECT ride_id, greatest(0, value * 10 - 5) AS a, least(1000, value * 10 + 5) AS b FROM points WHERE value < 100),
  n AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY a, b) AS rn FROM a),
  c AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY ride_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM n),
  g AS (SELECT *, sum(new) OVER (PARTITION BY ride_id ORDER BY rn) AS grp FROM c)
  SELECT ride_id, round(min(a), 6) AS region_start, round(max(b), 6) AS region_end FROM g GROUP BY ride_id, grp""")
def ts17_merged_regions(spark, d):
    rows = points(spark, d).where("value < 100").select("ride_id", (F.col("value") * 10).alias("t"), F.lit(1000.0).alias("duration"))
    return rounded(timeseries.merge_regions(rows, 5.0, "ride_id"), 6, "region_start", "region_end")


@query("""
  c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 10 AS dur FROM lineitem),
  e AS (SELECT *, least(5.0, dur / 2) AS low FROM c)
  SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n_times, round(sum(low + 45.0 * i), 6) AS total FROM (SELECT *, unnest(range(0, floor((greatest(low, dur - 5) - low) / 45)::INT + 1)) AS i FROM e) GROUP BY ALL""")
def ts18_coverage_times(spark, d):
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", timeseries.coverage_times(F.col("l_quantity") * 10).alias("times"))
    total = F.aggregate("times", F.lit(0.0), lambda a, x: a + x)
    return c.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.sum(F.size("times")).alias("n_times"), F.round(F.sum(total), 6).alias("total"))


@query("""RECURSIVE
  views AS (SELECT ride_id, coalesce(list(value ORDER BY ts, seq) FILTER (event_type = 'view'), []) AS hot FROM points GROUP BY ride_id),
  clicks AS (SELECT ride_id, value, row_number() OVER (PARTITION BY ride_id ORDER BY ts, seq) AS i FROM points WHERE event_type = 'click'),
  walk AS (
    SELECT ride_id, 0::BIGINT AS i, hot AS have FROM views
    UNION ALL
    SELECT w.ride_id, c.i, CASE WHEN len([y FOR y IN have IF abs(y - value) < 5]) = 0 THEN list_append(have, value) ELSE have END FROM walk w JOIN clicks c ON c.ride_id = w.ride_id AND c.i = w.i + 1)
  SELECT ride_id, array_to_string([round(y * 100)::BIGINT FOR y IN arg_max(have, i)], ',') AS times FROM walk GROUP BY ride_id""")
def ts19_injected_times(spark, d):
    """Per user, values of clicks injected into those of views unless within 5 of one before; in order of events, in hundredths."""
    ordered = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("ts", "seq", "value")))), lambda x: x["value"])
    rows = points(spark, d).groupBy("ride_id").agg(ordered("view").alias("hot"), ordered("click").alias("forced"))
    times = timeseries.injected_times(F.col("hot"), F.col("forced"))
    return rows.select("ride_id", F.array_join(F.transform(times, lambda y: F.round(y * 100).cast("long").cast("string")), ",").alias("times"))


@query("""
  g AS (SELECT l_orderkey AS ride_id, l_linenumber AS clip_name, l_partkey, l_linenumber * 20 AS clip_start, unnest(range(0, l_quantity::INT, 5)) AS video_sec FROM lineitem WHERE l_quantity::INT > 0)
  SELECT ride_id, clip_name, count(*) AS n, sum(clip_start + video_sec)::BIGINT AS total FROM g WHERE clip_start + video_sec <= 100 GROUP BY ride_id, clip_name""")
def ts20_frame_grid(spark, d):
    clips = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ride_id"), F.col("l_linenumber").alias("clip_name"), (F.col("l_linenumber") * 20).alias("clip_start"), F.col("l_quantity").alias("duration_secs"), F.lit(100).alias("ride_secs"))
    return timeseries.frame_grid(clips, step=5).groupBy("ride_id", "clip_name").agg(F.count(F.lit(1)).alias("n"), F.sum("ride_sec").alias("total"))


@query("""
  a AS (SELECT ride_id, seq, row_number() OVER (PARTITION BY ride_id ORDER BY ts, seq) - 1 AS rn, greatest(1, count(*) OVER (PARTITION BY ride_id) // 20) AS k FROM points)
  SELECT ride_id, seq FROM a WHERE rn % k = 0""")
def ts21_downsampled(spark, d):
    return timeseries.downsampled(points(spark, d), 20).select("ride_id", "seq")


# --- joins ----------------------------------------------------------------------------------------------------------

NEAREST = """
  pr AS (SELECT ride_id, seq, ts FROM points WHERE event_type = 'click'),
  pt AS (SELECT ride_id, seq AS p_seq, ts AS p_ts, value FROM points WHERE event_type = 'view'),
  j AS (SELECT pr.ride_id, pr.seq, p_ts, p_seq, value, abs(epoch_us(p_ts) - epoch_us(pr.ts)) / 1e6 AS gap, row_number() OVER (PARTITION BY pr.ride_id, pr.seq ORDER BY abs(epoch_us(p_ts) - epoch_us(pr.ts)), p_ts, p_seq) AS rn FROM pr JOIN pt USING (ride_id))"""


def _probes(spark, d, kind="click"):
    return points(spark, d).where(F.col("event_type") == kind).select("ride_id", "seq", F.col("ts").alias("probe_ts"))


def _views(spark, d):
    return points(spark, d).where("event_type = 'view'").select("ride_id", F.col("seq").alias("p_seq"), "ts", "value")


@query(NEAREST + "SELECT pr.ride_id, pr.seq, p_ts AS asof_ts, p_seq, value, gap AS asof_gap FROM pr LEFT JOIN (SELECT * FROM j WHERE rn = 1) USING (ride_id, seq)")
def j1_asof_nearest(spark, d):
    return joins.asof_nearest(_probes(spark, d), _views(spark, d), ["p_seq", "value"], seq="p_seq").drop("probe_ts")


@query("""
  r AS (SELECT ride_id, seq, ts, ts + INTERVAL 1 DAY AS e FROM points WHERE event_type = 'purchase')
  SELECT r.ride_id, r.seq, count(*) AS n, round(sum(p.value), 4) AS total FROM r JOIN points p ON r.ride_id = p.ride_id AND p.ts BETWEEN r.ts AND r.e GROUP BY ALL""")
def j2_in_range(spark, d):
    p = points(spark, d)
    ranges = p.where("event_type = 'purchase'").select("ride_id", "seq", F.col("ts").alias("start_ts"), F.expr("ts + interval 1 day").alias("end_ts"))
    pairs = joins.in_range(ranges, p.select("ride_id", "ts", "value"), bucket_secs=86400.0)
    return pairs.groupBy("ride_id", "seq").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


CLIPS = """
  base AS (SELECT ride_id, min(ts) AS t0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS ride_secs FROM points GROUP BY ride_id),
  clips AS (SELECT ride_id, seq AS clip_name, (epoch_us(ts) - epoch_us(t0)) / 1e6 AS clip_start, value * 1800 AS duration_secs, ride_secs FROM points JOIN base USING (ride_id) WHERE event_type = 'view'),
  probes AS (SELECT ride_id, seq, (epoch_us(ts) - epoch_us(t0)) / 1e6 AS at_secs FROM points JOIN base USING (ride_id) WHERE event_type <> 'view')"""


def _clips(spark, d):
    p = points(spark, d)
    base = p.groupBy("ride_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    rows = p.join(base, "ride_id").withColumn("at_secs", s.seconds_between(F.col("t0"), F.col("ts")))
    clips = rows.where("event_type = 'view'").select("ride_id", F.col("seq").alias("clip_name"), F.col("at_secs").alias("clip_start"), (F.col("value") * 1800).alias("duration_secs"), s.seconds_between(F.col("t0"), F.col("t1")).alias("ride_secs"))
    return clips.withColumn("clip_end", F.col("clip_start") + F.col("duration_secs")), rows.where("event_type <> 'view'").select("ride_id", "seq", "at_secs")


@query(CLIPS + """,
  f AS (SELECT p.ride_id, p.seq, arg_min(clip_name, (clip_start, clip_name)) AS clip_name, min(clip_start) AS c, any_value(at_secs) AS t FROM probes p JOIN clips c ON p.ride_id = c.ride_id AND at_secs BETWEEN clip_start AND clip_start + duration_secs GROUP BY ALL)
  SELECT ride_id, seq, clip_name, round(t - c, 3) AS video_secs FROM f""")
def j3_first_containing(spark, d):
    clips, probes = _clips(spark, d)
    return rounded(joins.first_containing(probes, clips), 3, "video_secs").select("ride_id", "seq", "clip_name", "video_secs")


@query(CLIPS + """,
  f AS (SELECT p.ride_id, p.seq, arg_min(clip_name, (clip_start, clip_name)) AS clip_name FROM probes p JOIN clips c ON p.ride_id = c.ride_id AND at_secs BETWEEN clip_start AND clip_start + duration_secs GROUP BY ALL)
  SELECT p.ride_id, p.seq, coalesce(clip_name::VARCHAR, '') AS clip_name FROM probes p LEFT JOIN f USING (ride_id, seq)""")
def j7_clip_of_frame(spark, d):
    clips, probes = _clips(spark, d)
    found = joins.first_containing(probes, clips, how="left")
    return found.select("ride_id", "seq", F.coalesce(F.col("clip_name").cast("string"), F.lit("")).alias("clip_name"))


@query(CLIPS + "SELECT ride_id, clip_name, round(greatest(0, clip_start), 3) AS span_start, round(least(ride_secs, clip_start + duration_secs), 3) AS span_end FROM clips WHERE clip_start + duration_secs >= 0 AND clip_start <= ride_secs")
def j5_overlapping_clips(spark, d):
    return rounded(joins.overlapping_clips(_clips(spark, d)[0]), 3, "span_start", "span_end").select("ride_id", "clip_name", "span_start", "span_end")


@query(CLIPS + ", h AS (SELECT ride_id, clip_name, duration_secs / 2 AS anchor, clip_start FROM clips) SELECT ride_id, clip_name, round(clip_start + anchor, 1) AS ride_time_secs FROM h")
def j4_snk10_enriched_hits(spark, d):
    """Anchors of hits as ride seconds, filled in where missing."""
    clips, _ = _clips(spark, d)
    hits = clips.select("ride_id", "clip_name", (F.col("duration_secs") / 2).alias("anchor_video_secs"), F.lit(None).cast("double").alias("video_secs"), F.lit(None).cast("double").alias("ride_time_secs"))
    at = hits.join(clips.select("ride_id", "clip_name", "clip_start"), ["ride_id", "clip_name"])
    base = F.timestamp_seconds(F.lit(0))
    wall = base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("clip_start").cast("decimal(18,6)"))
    return at.select("ride_id", "clip_name", F.round(joins.ride_second(wall, base, F.col("anchor_video_secs")), 1).alias("ride_time_secs"))


@query(NEAREST + "SELECT pr.ride_id, pr.seq, p_seq, value, gap AS asof_gap FROM pr LEFT JOIN (SELECT * FROM j WHERE rn = 1 AND gap <= 21600) USING (ride_id, seq)")
def j6_nearest_within_tolerance(spark, d):
    return joins.asof_nearest(_probes(spark, d), _views(spark, d), ["p_seq", "value"], seq="p_seq", tolerance_secs=6 * HOUR).drop("probe_ts", "asof_ts")


def _alignment(spark, d):
    side = lambda kind, name: points(spark, d).where(F.col("event_type") == kind).select("ride_id", F.col("seq").alias(name), s.epoch_seconds(F.col("ts")).alias("t"))
    return joins.greedy_match(side("click", "label_id"), side("error", "hit_id"), 6 * HOUR)


@query("""
  l AS (SELECT ride_id, count(*) AS n_labels FROM points WHERE event_type = 'click' GROUP BY ride_id),
  h AS (SELECT ride_id, count(*) AS n_hits FROM points WHERE event_type = 'error' GROUP BY ride_id)
  SELECT coalesce(l.ride_id, h.ride_id) AS ride_id, coalesce(n_labels, 0) AS n_labels, coalesce(n_hits, 0) AS n_hits FROM l FULL JOIN h USING (ride_id)""")
def j8_greedy_match(spark, d):
    """Labels and hits of the assignment, counted: none is lost or doubled. Which match is held by a test."""
    return _alignment(spark, d).groupBy("ride_id").agg(F.count("label_id").alias("n_labels"), F.count("hit_id").alias("n_hits"))


#: J-8 as recursion: label after label of each ride takes the nearest hit that isn't in the list of those taken.
MATCHED = """RECURSIVE
  lab AS (SELECT ride_id, seq AS label_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY ride_id ORDER BY ts, seq) AS i FROM points WHERE event_type = 'click'),
  hit AS (SELECT ride_id, seq AS hit_id, epoch_us(ts) / 1e6 AS t FROM points WHERE event_type = 'error'),
  near AS (SELECT ride_id, i, hit_id, abs(hit.t - lab.t) AS gap, hit.t FROM lab JOIN hit USING (ride_id) WHERE abs(hit.t - lab.t) <= 21600),
  walk AS (
    SELECT DISTINCT ride_id, 0::BIGINT AS i, NULL::BIGINT AS label_id, NULL::BIGINT AS hit_id, []::BIGINT[] AS taken FROM lab
    UNION ALL
    SELECT ride_id, i, label_id, best, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END FROM (
      SELECT w.ride_id, l.i, any_value(l.label_id) AS label_id, arg_min(n.hit_id, (n.gap, n.t, n.hit_id)) AS best, any_value(w.taken) AS taken
      FROM walk w JOIN lab l ON l.ride_id = w.ride_id AND l.i = w.i + 1
      LEFT JOIN near n ON n.ride_id = l.ride_id AND n.i = l.i AND NOT list_contains(w.taken, n.hit_id) GROUP BY w.ride_id, l.i)),
  aligned AS (
    SELECT ride_id, label_id, hit_id, CASE WHEN hit_id IS NULL THEN 'label_only' ELSE 'matched' END AS outcome FROM walk WHERE i > 0
    UNION ALL
    SELECT ride_id, NULL, hit_id, 'model_only' FROM hit WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.ride_id = hit.ride_id AND w.hit_id = hit.hit_id))"""


@query(MATCHED + " SELECT * FROM aligned")
def j8_greedy_match_rows(spark, d):
    return _alignment(spark, d)


WAYS = """
  way_v AS (SELECT n_nationkey AS way_id, n_name AS name, 'R' || (n_nationkey % 3) || ';Q' || (n_nationkey % 2) AS ref, i AS idx, 40 + (n_nationkey % 10) / 10.0::DOUBLE + i * 0.02::DOUBLE AS lat, -74 + (n_nationkey % 7) / 100.0::DOUBLE + i * 0.015::DOUBLE AS lon FROM nation, (SELECT unnest(range(0, 5)) AS i)),
  seg AS (SELECT way_id, lat AS a_lat, lon AS a_lon, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon FROM way_v WINDOW w AS (PARTITION BY way_id ORDER BY idx)),
  mid AS (SELECT ride_id, avg(lat) AS lat0 FROM points GROUP BY ride_id),
  xy AS (SELECT p.ride_id, p.seq, s.way_id, p.lon * 111320.0 * cos(radians(lat0)) AS px, p.lat * 111320.0 AS py, a_lon * 111320.0 * cos(radians(lat0)) AS ax, a_lat * 111320.0 AS ay, b_lon * 111320.0 * cos(radians(lat0)) AS bx, b_lat * 111320.0 AS by_
    FROM points p JOIN mid USING (ride_id), seg s WHERE b_lat IS NOT NULL AND p.lat BETWEEN least(a_lat, b_lat) - 0.01 AND greatest(a_lat, b_lat) + 0.01),
  tt AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) AS t FROM xy),
  dd AS (SELECT ride_id, seq, way_id, min(sqrt((px - (ax + t * (bx - ax))) ** 2 + (py - (ay + t * (by_ - ay))) ** 2)) AS dist FROM tt GROUP BY ALL),
  matched AS (SELECT ride_id, seq, coalesce(min(way_id) FILTER (dist < 3), arg_min(way_id, (dist, way_id))) AS way_id, coalesce(arg_min(dist, way_id) FILTER (dist < 3), min(dist)) AS dist_m FROM dd WHERE dist < 250 GROUP BY ALL)"""


def _ways(spark, d):
    n = table(spark, d, "nation").withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return n.select(F.col("n_nationkey").alias("way_id"), F.col("n_name").alias("name"), F.concat(F.lit("R"), F.col("n_nationkey") % 3, F.lit(";Q"), F.col("n_nationkey") % 2).alias("ref"), "idx", (F.lit(40.0) + (F.col("n_nationkey") % 10) / F.lit(10.0) + F.col("idx") * 0.02).alias("lat"), (F.lit(-74.0) + (F.col("n_nationkey") % 7) / F.lit(100.0) + F.col("idx") * 0.015).alias("lon"))


@query(WAYS + "SELECT ride_id, seq, way_id, round(dist_m, 3) AS dist_m FROM matched")
def j9_map_match(spark, d):
    return rounded(geo.match_ways(points(spark, d), geo.way_segments(_ways(spark, d)), 250.0), 3, "dist_m")


@query(WAYS + """,
  wn AS (SELECT DISTINCT way_id, name, ref FROM way_v),
  tot AS (SELECT ride_id, count(*) AS n_points FROM points GROUP BY ride_id),
  nm AS (SELECT ride_id, name AS v, count(*) AS n, min(seq) AS seen FROM matched JOIN wn USING (way_id) GROUP BY ALL),
  rf AS (SELECT ride_id, v, count(*) AS n, min(seq) AS seen FROM (SELECT ride_id, seq, unnest(string_split(ref, ';')) AS v FROM matched JOIN wn USING (way_id)) GROUP BY ALL),
  n1 AS (SELECT ride_id, max(n) AS n_name, arg_max(v, (n, -seen, v)) AS name FROM nm GROUP BY ride_id),
  r1 AS (SELECT ride_id, max(n) AS n_ref, arg_max(v, (n, -seen, v)) AS ref FROM rf GROUP BY ride_id)
  SELECT ride_id, CASE WHEN coalesce(n_ref, 0) >= 10 AND coalesce(n_ref, 0) >= coalesce(n_name, 0) THEN ref ELSE coalesce(name, '') END AS road, coalesce(CASE WHEN coalesce(n_ref, 0) >= 10 AND coalesce(n_ref, 0) >= coalesce(n_name, 0) THEN n_ref ELSE n_name END, 0) AS n_road, n_points, round(n_road / n_points, 9) AS coverage
  FROM tot LEFT JOIN n1 USING (ride_id) LEFT JOIN r1 USING (ride_id)""")
def a4_road_attribution(spark, d):
    p, ways = points(spark, d), _ways(spark, d)
    matches = geo.match_ways(p, geo.way_segments(ways), 250.0)
    return rounded(geo.road_attribution(p, matches, ways.select("way_id", "name", "ref").distinct(), 10), 9, "coverage")


PARKS = """
  park AS (SELECT s_suppkey AS poly_id, 'park ' || (s_suppkey % 8) AS name, 40 + (s_suppkey % 100) / 100.0::DOUBLE AS s, -74 + (s_suppkey % 9) / 100.0::DOUBLE AS w FROM supplier),
  inside AS (SELECT ride_id, seq, poly_id, name FROM points JOIN park ON lat + 1e-9 > s AND lat + 1e-9 < s + 0.0305 AND lon + 1e-9 > w AND lon + 1e-9 < w + 0.0205)"""


def _parks(spark, d):
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(a).alias("da"), F.lit(b).alias("db")) for i, (a, b) in enumerate(((0.0, 0.0), (0.0, 0.0205), (0.0305, 0.0205), (0.0305, 0.0)))]))
    p = table(spark, d, "supplier").withColumn("c", corner)
    return p.select(F.col("s_suppkey").alias("poly_id"), F.concat(F.lit("park "), F.col("s_suppkey") % 8).alias("name"), "c.idx", (F.lit(40.0) + (F.col("s_suppkey") % 100) / F.lit(100.0) + F.col("c.da")).alias("lat"), (F.lit(-74.0) + (F.col("s_suppkey") % 9) / F.lit(100.0) + F.col("c.db")).alias("lon"))


@query(PARKS + "SELECT ride_id, seq, count(*) AS n_parks FROM inside GROUP BY ride_id, seq")
def j10_points_in_polygons(spark, d):
    outlines, members = geo.shapes(_parks(spark, d))
    inside = geo.points_in_shapes(_shifted(spark, d), outlines, poly="shape_id").join(members.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n")), "shape_id")
    return inside.groupBy("ride_id", "seq").agg(F.sum("n").alias("n_parks"))


PARK_SHARE = PARKS + """,
  held AS (SELECT ride_id, name, count(*) AS n, min(poly_id) AS first_poly FROM inside GROUP BY ALL),
  best AS (SELECT ride_id, max(n) AS n, arg_min(name, (-n, first_poly, name)) AS name FROM held GROUP BY ride_id),
  shares AS (SELECT ride_id, coalesce(name, '') AS park, coalesce(n, 0) / n_points AS share FROM (SELECT ride_id, count(*) AS n_points FROM points GROUP BY ride_id) LEFT JOIN best USING (ride_id))"""


def _shifted(spark, d):
    """Points off the corners of parks, where rounding would decide."""
    return points(spark, d).withColumn("lat", F.col("lat") + 1e-9).withColumn("lon", F.col("lon") + 1e-9)


def _park_share(spark, d):
    parks, p = _parks(spark, d), _shifted(spark, d)
    outlines, members = geo.shapes(parks)
    return geo.park_share(p, geo.points_in_shapes(p, outlines, poly="shape_id"), parks.select("poly_id", "name").distinct(), members)


@query(PARK_SHARE + " SELECT * FROM shares")
def j10_park_share(spark, d):
    return _park_share(spark, d)


PLACES = """
  pl AS (SELECT 'town ' || s_suppkey AS name, 1 + s_suppkey % 4 AS rank, 40 + (s_suppkey % 100) / 100.0::DOUBLE AS lat, -74 + (s_suppkey % 9) / 100.0::DOUBLE AS lon FROM supplier),
  pin AS (SELECT ride_id, arg_min(lat, seq) AS pin_lat, arg_min(lon, seq) AS pin_lon FROM points GROUP BY ride_id),
  near AS (SELECT ride_id, name, rank, 1609.344 * 2 * 3958.8 * asin(sqrt(sin(radians(lat - pin_lat) / 2) ** 2 + cos(radians(pin_lat)) * cos(radians(lat)) * sin(radians(lon - pin_lon) / 2) ** 2)) AS dist FROM pin, pl)"""


def _places(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("town "), "s_suppkey").alias("name"), (1 + F.col("s_suppkey") % 4).alias("rank"), (F.lit(40.0) + (F.col("s_suppkey") % 100) / F.lit(100.0)).alias("lat"), (F.lit(-74.0) + (F.col("s_suppkey") % 9) / F.lit(100.0)).alias("lon"))


@query(PLACES + "SELECT ride_id, arg_min(name, (rank, dist, name)) AS place FROM near WHERE dist <= 2500 GROUP BY ride_id")
def j11_best_place(spark, d):
    pins = points(spark, d).groupBy("ride_id").agg(F.min_by("lat", "seq").alias("pin_lat"), F.min_by("lon", "seq").alias("pin_lon"))
    return geo.best_place(pins, _places(spark, d))


def _haversine_sql(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    return f"7917.6 * asin(sqrt(sin(radians({b_lat} - {a_lat}) / 2) ** 2 + cos(radians({a_lat})) * cos(radians({b_lat})) * sin(radians({b_lon} - {a_lon}) / 2) ** 2))"


@query(WAYS + "," + PARK_SHARE.lstrip() + f""",
  pl AS (SELECT 'town ' || s_suppkey AS name, 1 + s_suppkey % 4 AS rank, 40 + (s_suppkey % 100) / 100.0::DOUBLE AS lat, -74 + (s_suppkey % 9) / 100.0::DOUBLE AS lon FROM supplier),
  wn AS (SELECT DISTINCT way_id, name, ref FROM way_v),
  tot AS (SELECT ride_id, count(*) AS n_points FROM points GROUP BY ride_id),
  nm AS (SELECT ride_id, name AS v, count(*) AS n, min(seq) AS seen FROM matched JOIN wn USING (way_id) GROUP BY ALL),
  rf AS (SELECT ride_id, v, count(*) AS n, min(seq) AS seen FROM (SELECT ride_id, seq, unnest(string_split(ref, ';')) AS v FROM matched JOIN wn USING (way_id)) GROUP BY ALL),
  n1 AS (SELECT ride_id, max(n) AS n_name, arg_max(v, (n, -seen, v)) AS name FROM nm GROUP BY ride_id),
  r1 AS (SELECT ride_id, max(n) AS n_ref, arg_max(v, (n, -seen, v)) AS ref FROM rf GROUP BY ride_id),
  roads AS (SELECT ride_id, coalesce(n_ref, 0) >= 10 AND coalesce(n_ref, 0) >= coalesce(n_name, 0) AS by_ref, name, ref, n_name, n_ref, n_points FROM tot LEFT JOIN n1 USING (ride_id) LEFT JOIN r1 USING (ride_id)),
  ends AS (SELECT ride_id, arg_min(lat, seq) AS lat0, arg_min(lon, seq) AS lon0, arg_max(lat, seq) AS lat1, arg_max(lon, seq) AS lon1, max(distance) / 1609.344 AS mi FROM points GROUP BY ride_id),
  away AS (SELECT ride_id, seq, lat, lon, {_haversine_sql("lat0", "lon0", "lat", "lon")} AS far FROM points JOIN ends USING (ride_id)),
  apex AS (SELECT ride_id, max(far) AS far, arg_max(lat, (far, -seq)) AS lat2, arg_max(lon, (far, -seq)) AS lon2 FROM away GROUP BY ride_id),
  kinds AS (SELECT *, CASE WHEN far < 5 THEN 'local_loop' WHEN {_haversine_sql("lat0", "lon0", "lat1", "lon1")} >= 5 THEN 'point_to_point' ELSE 'out_and_back' END AS ride_type FROM ends JOIN apex USING (ride_id)),
  pins AS (SELECT ride_id, 'start' AS pin, lat0 AS plat, lon0 AS plon FROM kinds UNION ALL SELECT ride_id, 'end', CASE ride_type WHEN 'point_to_point' THEN lat1 ELSE lat2 END, CASE ride_type WHEN 'point_to_point' THEN lon1 ELSE lon2 END FROM kinds WHERE ride_type <> 'local_loop'),
  close_ AS (SELECT ride_id, pin, name, rank, 1609.344 * {_haversine_sql("plat", "plon", "lat", "lon")} AS dist FROM pins, pl WHERE abs(plat - lat) < 0.03),
  placed AS (SELECT ride_id, pin, arg_min(name, (rank, dist, name)) AS place FROM close_ WHERE dist <= 2500 GROUP BY ALL)
  SELECT k.ride_id, ride_type, round(mi, 6) AS distance_mi, upper(CASE WHEN ride_type = 'local_loop' AND share >= 0.5 THEN park ELSE coalesce(s.place, 'UNKNOWN') END) AS origin,
    CASE WHEN ride_type = 'local_loop' THEN '' ELSE upper(coalesce(e.place, 'UNKNOWN')) END AS destination, upper(CASE WHEN by_ref THEN ref ELSE coalesce(name, '') END) AS road, round(coalesce(CASE WHEN by_ref THEN n_ref ELSE n_name END, 0) / n_points, 9) AS coverage
  FROM kinds k JOIN roads USING (ride_id) JOIN shares USING (ride_id) LEFT JOIN placed s ON k.ride_id = s.ride_id AND s.pin = 'start' LEFT JOIN placed e ON k.ride_id = e.ride_id AND e.pin = 'end'""")
def a19_route_metadata(spark, d):
    p, ways = points(spark, d), _ways(spark, d)
    park = _park_share(spark, d)
    roads = geo.road_attribution(p, geo.match_ways(p, geo.way_segments(ways), 250.0), ways.select("way_id", "name", "ref").distinct(), 10)
    return rounded(rounded(geo.route_metadata(p, park, roads, _places(spark, d)), 6, "distance_mi"), 9, "coverage")


@query("""
  o AS (SELECT ride_id, seq AS clip_name, seq % 23 AS v FROM points WHERE event_type = 'view'),
  m AS (SELECT ride_id, median(v) AS mid FROM o GROUP BY ride_id)
  SELECT ride_id, clip_name, round(CASE WHEN abs(v - mid) <= 5 THEN v ELSE mid END, 6)::DOUBLE AS offset_secs FROM o JOIN m USING (ride_id)""")
def j12_clip_offsets(spark, d):
    clips = points(spark, d).where("event_type = 'view'").select("ride_id", F.col("seq").alias("clip_name"))
    return joins.clip_offsets(clips, clips.withColumn("offset", (F.col("clip_name") % 23).cast("double")))


@query("""
  c AS (SELECT ride_id, seq, event_type FROM points WHERE event_type IN ('view', 'click')),
  k AS (SELECT DISTINCT ride_id, seq FROM points WHERE value > 50),
  cached AS (SELECT DISTINCT ride_id FROM points WHERE event_type = 'error' AND value > 150)
  SELECT c.ride_id, c.seq, k.seq IS NOT NULL AS selected FROM c LEFT JOIN k USING (ride_id, seq) WHERE c.ride_id NOT IN (SELECT ride_id FROM cached)""")
def j13_j14_selected_and_not_cached(spark, d):
    p = points(spark, d)
    rows = joins.marked_selected(p.where("event_type in ('view', 'click')").select("ride_id", "seq"), p.where("value > 50"), ["ride_id", "seq"])
    return joins.not_cached(rows, p.where("event_type = 'error' and value > 150"), "ride_id").select("ride_id", "seq", "selected")


@query("""
  c AS (SELECT ride_id, seq, (row_number() OVER (PARTITION BY ride_id ORDER BY seq) - 1) AS pos FROM points WHERE event_type = 'view'),
  k AS (SELECT ride_id, seq % 40 AS pos, seq AS sel FROM points WHERE event_type = 'click')
  SELECT k.ride_id, sel, c.seq AS stable_id FROM k JOIN c USING (ride_id, pos)""")
def j15_by_position(spark, d):
    p = points(spark, d)
    keys = p.where("event_type = 'click'").select("ride_id", F.col("seq").alias("sel"), (F.col("seq") % 40).cast("string").alias("sel_key"))
    items = p.where("event_type = 'view'").select("ride_id", "seq", F.col("seq").alias("stable_id"))
    return joins.by_position(keys, items.withColumn("stable_id", F.col("stable_id").cast("string"))).select("ride_id", "sel", F.col("stable_id").cast("long").alias("stable_id"))


@query("""
  f AS (SELECT ride_id, arg_min(lat, seq) AS lat0, arg_min(lon, seq) AS lon0 FROM points GROUP BY ride_id),
  q AS (SELECT ride_id, seq, CASE WHEN ride_id % 2 = 0 THEN pow(lat - 40.05::DOUBLE, 2) + pow(lon - (-73.95)::DOUBLE, 2) ELSE -(pow(lat - lat0, 2) + pow(lon - lon0, 2)) END AS m FROM points JOIN f USING (ride_id))
  SELECT ride_id, arg_min(seq, (m, seq)) AS vertex_idx FROM q GROUP BY ride_id""")
def j16_nearest_vertex(spark, d):
    p = points(spark, d).select("ride_id", F.col("seq").alias("idx"), "lat", "lon")
    pins = p.where("ride_id % 2 = 0").select("ride_id").distinct().withColumns({"pin_lat": F.lit(40.05), "pin_lon": F.lit(-73.95)})
    return joins.nearest_vertex(pins, p)


#: Every second of each clip.
CLIP_SECONDS = CLIPS + """,
  short AS (SELECT ride_id, clip_name, round(clip_start * 1e6)::BIGINT AS c, floor(duration_secs)::BIGINT AS last_ FROM clips),
  secs AS (SELECT ride_id, clip_name, c, unnest(range(0, last_ + 1)) AS k FROM short),
  at_ AS (SELECT ride_id, clip_name, k, c + k * 1000000 AS us FROM secs),
  pt AS (SELECT ride_id, seq, epoch_us(ts) - epoch_us(t0) AS us FROM points JOIN base USING (ride_id)),
  one AS (SELECT ride_id, us, min(seq) AS seq FROM pt GROUP BY ALL),
  early AS (SELECT a.*, o.us AS us0, o.seq AS seq0 FROM at_ a ASOF LEFT JOIN one o ON a.ride_id = o.ride_id AND a.us >= o.us),
  both_ AS (SELECT e.*, o.us AS us1, o.seq AS seq1 FROM early e ASOF LEFT JOIN one o ON e.ride_id = o.ride_id AND e.us <= o.us),
  fed AS (SELECT ride_id, clip_name, k, CASE WHEN us1 IS NULL OR us - us0 <= us1 - us THEN seq0 ELSE seq1 END AS seq FROM both_)"""
GRADED = """,
  steps AS (SELECT ride_id, seq, speed, distance, altitude, altitude - lag(altitude) OVER w AS rise, distance - lag(distance) OVER w AS run FROM points WINDOW w AS (PARTITION BY ride_id ORDER BY ts, seq)),
  graded AS (SELECT *, CASE WHEN rise IS NULL OR run IS NULL OR run < 0.5 THEN 0 ELSE rise / run * 100 END AS grade FROM steps)"""


@query(CLIP_SECONDS + GRADED + """
  SELECT ride_id, clip_name, k::DOUBLE AS video_sec, seq, round(grade, 6) AS grade, round(nullif(speed, 0) * 2.23694, 9) AS mph, round(nullif(distance, 0) / 1609.344, 6) AS miles, round(nullif(altitude, 0) * 3.28084, 6) AS feet FROM fed JOIN graded USING (ride_id, seq)""")
def j17_clip_feed(spark, d):
    """Every second of each clip with the nearest point, its gradient, mph, miles and feet."""
    clips, _ = _clips(spark, d)
    p = timeseries.point_gradient(points(spark, d))
    base = p.groupBy("ride_id").agg(F.min("ts").alias("t0"))
    none = lambda c: F.when(c != 0, c)
    # Rounded by the point: a point is nearest to thousands of seconds.
    told = p.select("ride_id", "ts", "seq", "grade", none(s.mph(F.col("speed"))).alias("mph"), none(s.miles(F.col("distance"))).alias("miles"), none(s.feet(F.col("altitude"))).alias("feet"))
    told = rounded(rounded(told, 6, "grade", "miles", "feet"), 9, "mph")
    return joins.clip_feed(clips, told, base, ["seq", "grade", "mph", "miles", "feet"]).select("ride_id", "clip_name", "video_sec", "seq", "grade", "mph", "miles", "feet")


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("SELECT ride_id, count(*) AS n_points, round(avg(power), 6) AS avg_power, max(power) AS max_power, round(avg(value), 6) AS avg_value, max(value) AS max_value FROM points GROUP BY ride_id")
def a1_series_summary(spark, d):
    return rounded(aggregates.series_summary(points(spark, d), ["power", "value"]), 6, "avg_power", "avg_value")


def _sessions(spark, d):
    return points(spark, d).groupBy("ride_id").agg(F.max(F.when(F.col("ride_id") % 2 == 0, F.col("distance"))).alias("total_distance"), F.lit(0.0).alias("total_timer_time"), F.lit(None).cast("double").alias("max_speed"), F.lit(None).cast("double").alias("avg_speed"))


@query("""
  a AS (SELECT ride_id, max(distance) AS dist, max(speed) AS ms, avg(nullif(speed, 0)) AS sp, avg(nullif(power, 0)) AS po, count(*) AS n, min(ts) AS t0 FROM points GROUP BY ride_id)
  SELECT ride_id, round(dist / 1609.344, 6) AS distance_mi, n::DOUBLE AS moving_secs, round(ms * 2.23694, 6) AS top_mph, round(sp * 2.23694, 6) AS avg_mph, round(po, 6) AS avg_power, t0::DATE::VARCHAR AS ride_date FROM a""")
def a2_ride_stats(spark, d):
    out = aggregates.ride_stats(points(spark, d), _sessions(spark, d))
    return rounded(out, 6, "distance_mi", "top_mph", "avg_mph", "avg_power").select("ride_id", "distance_mi", F.col("moving_secs").cast("double").alias("moving_secs"), "top_mph", "avg_mph", "avg_power", F.col("ride_date").cast("string").alias("ride_date"))


@query("""
  f AS (SELECT ride_id, arg_min(lat, seq) AS lat0, arg_min(lon, seq) AS lon0, arg_max(lat, seq) AS lat1, arg_max(lon, seq) AS lon1, max(distance) / 1609.344 AS mi FROM points GROUP BY ride_id),
  h AS (SELECT ride_id, max(7917.6 * asin(sqrt(sin(radians(lat - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin(radians(lon - lon0) / 2) ** 2))) AS far FROM points JOIN f USING (ride_id) GROUP BY ride_id),
  e AS (SELECT *, 7917.6 * asin(sqrt(sin(radians(lat1 - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat1)) * sin(radians(lon1 - lon0) / 2) ** 2)) AS e2s FROM f JOIN h USING (ride_id))
  SELECT ride_id, CASE WHEN far < 5 THEN 'local_loop' WHEN e2s >= 5 THEN 'point_to_point' ELSE 'out_and_back' END AS ride_type, round(far, 6) AS max_dist_mi, round(e2s, 6) AS end_to_start_mi, round(mi, 6) AS distance_mi FROM e""")
def a3_classified(spark, d):
    return rounded(geo.classified(points(spark, d)), 6, "max_dist_mi", "end_to_start_mi", "distance_mi").select("ride_id", "ride_type", "max_dist_mi", "end_to_start_mi", "distance_mi")


def _pairs(spark, d):
    """Alignment rows with the ratings of both sides, from event ids."""
    rows = _alignment(spark, d)
    visual = lambda c, k: (F.col(c) % k).cast("int")
    kind = lambda c: F.element_at(F.array(*map(F.lit, ("descent", "group_riding", "landmark"))), (F.col(c) % 3 + 1).cast("int"))
    return rows.select("*", kind("label_id").alias("label_type"), visual("label_id", 10).alias("label_visual"), visual("label_id", 7).alias("label_action"), kind("hit_id").alias("model_type"), visual("hit_id", 9).alias("model_visual"), visual("hit_id", 8).alias("model_action"))


AGREED = MATCHED + """,
  told AS (SELECT ride_id, count(*) FILTER (outcome = 'matched') AS n_matched, count(*) FILTER (outcome = 'label_only') AS n_label_only, count(*) FILTER (outcome = 'model_only') AS n_model_only FROM aligned GROUP BY ride_id),
  agreed AS (SELECT *, n_matched + n_label_only AS n_labels, n_matched + n_model_only AS n_model_hits FROM told)"""
RATED = MATCHED + """,
  kinds AS (SELECT ['descent', 'group_riding', 'landmark'] AS k),
  rated AS (SELECT ride_id, label_id, hit_id, outcome, k[label_id % 3 + 1] AS label_type, (label_id % 10)::INT AS label_visual, (label_id % 7)::INT AS label_action, k[hit_id % 3 + 1] AS model_type, (hit_id % 9)::INT AS model_visual, (hit_id % 8)::INT AS model_action,
    outcome = 'matched' AND label_id % 10 <> 0 AND hit_id % 9 <> 0 AS scored FROM aligned, kinds)"""


@query(AGREED + """
  SELECT *, coalesce(round_even(n_matched / nullif(n_model_hits, 0), 3), 0)::DOUBLE AS precision, coalesce(round_even(n_matched / nullif(n_labels, 0), 3), 0)::DOUBLE AS recall FROM agreed""")
def a5_agreement(spark, d):
    return evaluate.agreement(_alignment(spark, d))


@query(RATED + """
  SELECT ride_id, count(*) FILTER (scored) AS n_scored,
    round_even(avg(model_visual - label_visual) FILTER (scored), 2) AS visual_mean_diff, round_even(avg(model_action - label_action) FILTER (scored), 2) AS action_mean_diff,
    count(*) FILTER (scored AND label_type = model_type) AS n_same_type, round_even(avg((label_type = model_type)::INT) FILTER (scored), 2) AS type_rate,
    round_even(avg(model_visual) FILTER (outcome = 'matched'), 1) AS avg_matched_visual, round_even(avg(model_action) FILTER (outcome = 'matched'), 1) AS avg_matched_action,
    round_even(avg(model_visual) FILTER (outcome = 'model_only'), 1) AS avg_model_only_visual, round_even(avg(model_action) FILTER (outcome = 'model_only'), 1) AS avg_model_only_action,
    min(greatest(model_visual, model_action)) FILTER (outcome = 'matched') AS min_matched_max
  FROM rated GROUP BY ride_id""")
def a6_patterns(spark, d):
    return evaluate.patterns(_pairs(spark, d))


@query(RATED + " SELECT ride_id, label_type, count(*) AS n FROM rated WHERE outcome = 'label_only' GROUP BY ALL")
def a6_misses_by_type(spark, d):
    return evaluate.counts_by_type(_pairs(spark, d), "label_only", "label_type")


@query(AGREED + """,
  total AS (SELECT count(*) AS n_rides, sum(n_labels)::BIGINT AS n_labels, sum(n_model_hits)::BIGINT AS n_model_hits, sum(n_matched)::BIGINT AS n_matched, sum(n_label_only)::BIGINT AS n_label_only, sum(n_model_only)::BIGINT AS n_model_only FROM agreed)
  SELECT *, round_even(n_matched / nullif(n_model_hits, 0), 3) AS precision, round_even(n_matched / nullif(n_labels, 0), 3) AS recall FROM total""")
def a7_roll_up(spark, d):
    return evaluate.roll_up(evaluate.agreement(_alignment(spark, d)))


@query(RATED + """
  SELECT ride_id, label_id, label_type, label_visual, label_action, (row_number() OVER (PARTITION BY ride_id ORDER BY label_id))::INT AS place FROM rated WHERE outcome = 'label_only'""")
def a7_missed(spark, d):
    return evaluate.missed(_pairs(spark, d))


@query(RATED + """,
  top AS (SELECT ride_id, hit_id, greatest(model_visual, model_action) AS top_score FROM rated WHERE outcome = 'model_only')
  SELECT ride_id, hit_id, top_score, (row_number() OVER (PARTITION BY ride_id ORDER BY top_score DESC, hit_id))::INT AS place FROM top QUALIFY place <= 15""")
def a7_top_overflags(spark, d):
    return evaluate.top_overflags(_pairs(spark, d)).select("ride_id", "hit_id", "top_score", "place")


@query(CLIPS + """,
  smp AS (SELECT ride_id, clip_name, i, clip_start + i * greatest(0.5, duration_secs / 8) AS secs FROM clips, (SELECT unnest(range(0, 9)) AS i) WHERE i <= floor(duration_secs / greatest(0.5, duration_secs / 8))),
  asked AS (SELECT ride_id, clip_name, i, 0 AS back, round(secs * 1e6)::BIGINT AS us FROM smp UNION ALL SELECT ride_id, clip_name, i, 5, round(greatest(0, secs - 5) * 1e6)::BIGINT FROM smp),
  pt AS (SELECT ride_id, seq, epoch_us(ts) - epoch_us(t0) AS us, speed, power, heart_rate, altitude, distance FROM points JOIN base USING (ride_id)),
  near AS (SELECT a.ride_id, clip_name, i, back, speed, power, heart_rate, altitude, distance, row_number() OVER (PARTITION BY a.ride_id, clip_name, i, back ORDER BY abs(pt.us - a.us), pt.us, seq) AS rn FROM asked a JOIN pt ON a.ride_id = pt.ride_id),
  pair AS (SELECT n.*, p.altitude AS alt0, p.distance AS dist0 FROM near n JOIN near p USING (ride_id, clip_name, i) WHERE n.rn = 1 AND p.rn = 1 AND n.back = 0 AND p.back = 5 AND n.speed IS NOT NULL),
  g AS (SELECT *, CASE WHEN altitude - alt0 IS NULL OR distance - dist0 IS NULL THEN NULL WHEN distance - dist0 < 0.5 THEN 0 ELSE (altitude - alt0) / (distance - dist0) * 100 END AS grade FROM pair)
  SELECT ride_id, clip_name, count(*) AS n_samples, round(avg(speed), 6) AS avg_speed, max(speed) AS peak_speed, round(avg(power), 6) AS avg_power, max(power) AS peak_power, round(avg(heart_rate), 6) AS avg_heart_rate, max(heart_rate) AS peak_heart_rate, round(avg(grade), 6) AS avg_grade, round(arg_max(grade, (abs(grade), grade)), 6) AS peak_grade FROM g GROUP BY ALL""")
def a8_clip_telemetry(spark, d):
    """Up to nine samples of each clip with their nearest points: averages, peaks and the gradient from five seconds before."""
    clips, _ = _clips(spark, d)
    p = points(spark, d)
    base = p.groupBy("ride_id").agg(F.min("ts").alias("t0"))
    named = clips.select("ride_id", "clip_name", F.col("clip_start").alias("start_secs"), F.col("duration_secs").alias("length_secs"))
    found = aggregates.sample_points(aggregates.clip_samples(named, key=["ride_id", "clip_name"]), p, base)
    rows = aggregates.sample_summary(found, ["power", "speed", "heart_rate"], key=["ride_id", "clip_name"])
    return rounded(rows, 6, "avg_power", "avg_speed", "avg_heart_rate", "avg_grade", "peak_grade")


@query(CLIPS + """,
  smp AS (SELECT ride_id, clip_name, i, clip_start + i * greatest(0.5, duration_secs / 8) AS secs FROM clips, (SELECT unnest(range(0, 9)) AS i) WHERE i <= floor(duration_secs / greatest(0.5, duration_secs / 8))),
  asked AS (SELECT ride_id, clip_name, i, 0 AS back, round(secs * 1e6)::BIGINT AS us FROM smp UNION ALL SELECT ride_id, clip_name, i, 5, round(greatest(0, secs - 5) * 1e6)::BIGINT FROM smp),
  pt AS (SELECT ride_id, seq, epoch_us(ts) - epoch_us(t0) AS us, speed, power, heart_rate, altitude, distance FROM points JOIN base USING (ride_id)),
  near AS (SELECT a.ride_id, clip_name, i, back, speed, power, heart_rate, altitude, distance, row_number() OVER (PARTITION BY a.ride_id, clip_name, i, back ORDER BY abs(pt.us - a.us), pt.us, seq) AS rn FROM asked a JOIN pt ON a.ride_id = pt.ride_id),
  pair AS (SELECT n.*, p.altitude AS alt0, p.distance AS dist0 FROM near n JOIN near p USING (ride_id, clip_name, i) WHERE n.rn = 1 AND p.rn = 1 AND n.back = 0 AND p.back = 5),
  g AS (SELECT *, speed * 2.23694 AS mph, CASE WHEN ride_id % 3 > 0 THEN coalesce(power, 0) END AS watts, CASE WHEN altitude - alt0 IS NULL OR distance - dist0 IS NULL OR distance - dist0 < 0.5 THEN 0 ELSE (altitude - alt0) / (distance - dist0) * 100 END AS grade FROM pair),
  l AS (SELECT *, 'Frame ' || i || ': ' || CASE WHEN speed IS NULL THEN 'no data' ELSE concat_ws(' ', round_even(mph, 0)::BIGINT || 'mph', watts || 'W', coalesce(heart_rate, 0) || 'bpm', CASE WHEN grade < 0 THEN '-' ELSE '+' END || abs(round_even(grade, 0))::BIGINT || '%') END AS line FROM g)
  SELECT ride_id, clip_name, CASE WHEN count(speed) > 0 THEN concat_ws(' ', 'Baseline: avg ' || round_even(avg(mph), 0)::BIGINT || 'mph', round_even(avg(watts) FILTER (speed IS NOT NULL), 0)::BIGINT || 'W') || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY i) AS block FROM l GROUP BY ALL""")
def a9_telemetry_block(spark, d):
    """The text about nine samples of each clip; every third ride is told without power."""
    clips, _ = _clips(spark, d)
    p = points(spark, d)
    base = p.groupBy("ride_id").agg(F.min("ts").alias("t0"))
    named = clips.select("ride_id", "clip_name", F.col("clip_start").alias("start_secs"), F.col("duration_secs").alias("length_secs"))
    frames = aggregates.clip_samples(named, key=["ride_id", "clip_name"]).withColumnRenamed("sample_no", "frame")
    powered = base.select("ride_id", (F.col("ride_id") % 3 > 0).alias("has_power"))
    return aggregates.telemetry_block(frames, aggregates.sample_points(frames, p, base), powered, ["ride_id", "clip_name"])


@query("""
  a AS (SELECT conv_id, turn, role || ': ' || coalesce(text, '') AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
  SELECT conv_id, string_agg(line, chr(10) ORDER BY rn) || CASE WHEN any_value(n) > 4 THEN chr(10) || '... ' || (any_value(n) - 4) || ' more' ELSE '' END AS digest, any_value(n) AS n FROM a WHERE rn <= 4 GROUP BY conv_id""")
def a9_a18_text_digest(spark, d):
    rows = table(spark, d, "conversations")
    return aggregates.text_lines(rows, F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit(""))), "conv_id", ["turn", "role", "text"], 4)


@query("""
  o AS (SELECT ride_id, seq, distance, altitude, row_number() OVER (PARTITION BY ride_id ORDER BY seq) - 1 AS rn, greatest(1, count(*) OVER (PARTITION BY ride_id) // 50) AS k FROM points WHERE altitude IS NOT NULL AND distance IS NOT NULL),
  l AS (SELECT ride_id, string_agg(round(distance / 1609.344 * 1000)::BIGINT || ':' || round(altitude * 3.28084 * 100000)::BIGINT, ',' ORDER BY seq) AS profile FROM o WHERE rn % k = 0 GROUP BY ride_id),
  b AS (SELECT ride_id, round(max(distance) / 1609.344, 6) AS total_mi, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM points GROUP BY ride_id)
  SELECT * FROM b LEFT JOIN l USING (ride_id)""")
def a10_route_bounds(spark, d):
    """Bounds and the profile, as thousandths of a mile and hundred-thousandths of a foot."""
    whole = lambda x, n: F.round(x * n).cast("long").cast("string")
    line = F.array_join(F.transform("profile", lambda p: F.concat(whole(p["mi"], 1000), F.lit(":"), whole(p["ft"], 100000))), ",")
    return rounded(aggregates.profile(points(spark, d), rows=50), 6, "total_mi").withColumn("profile", line)


@query(CLIPS + """,
  q AS (SELECT p.ride_id, p.seq, c.clip_name, round(at_secs - clip_start, 1) AS video_secs FROM probes p JOIN clips c ON p.ride_id = c.ride_id AND at_secs BETWEEN clip_start - 1 AND clip_start + duration_secs + 1)
  SELECT ride_id, clip_name, count(*) AS n, round(sum(video_secs), 1) AS total FROM q GROUP BY ALL""")
def a11_clip_payload(spark, d):
    clips, probes = _clips(spark, d)
    rows = aggregates.clip_payload(clips.select("ride_id", "clip_name", "clip_start", "clip_end"), probes)
    return rows.groupBy("ride_id", "clip_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("video_secs"), 1).alias("total"))


@query("""
  f AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'misc' ELSE 'x/' || strftime(o_orderdate, '%Y-%m-%d') END AS ride_folder, o_orderkey AS length, o_orderkey % 11 AS k FROM orders),
  g AS (SELECT ride_folder, count(*) FILTER (k IN (1, 2, 3)) AS raw_files, (count(*) FILTER (k = 5) > 0)::BIGINT + (count(*) FILTER (k = 6) > 0)::BIGINT AS raw_folders, coalesce(sum(length) FILTER (k IN (1, 2, 3, 5, 6)), 0)::BIGINT AS raw_bytes, bool_or(k = 7) AS has_highlights FROM f GROUP BY ride_folder)
  SELECT ride_folder, raw_files, raw_folders, raw_bytes, has_highlights, CASE WHEN ride_folder = 'misc' THEN 'no date' WHEN ride_folder[3:] > '1997-01-01' THEN 'recent' WHEN NOT has_highlights THEN 'no highlights' WHEN raw_files + raw_folders = 0 THEN 'nothing to free' END AS skip_reason FROM g""")
def a12_retention(spark, d):
    """Orders as files of eleven kinds: raw, data, in folders that can go or stay, highlights and what only looks like them."""
    key = F.col("o_orderkey")
    paths = ["ride.json", "GX01.MP4", "GL01.LRV", "GX01.THM", "clip.360", "frames/0001.jpg", "_work/a/b.mp4", "highlights/1.mp4", "highlights/list.json", "highlights.txt", "old/GX02.MP4"]
    path = F.get(F.array(*map(F.lit, paths)), (key % 11).cast("int"))
    folder = F.when(key % 50 == 0, "misc").otherwise(F.concat(F.lit("x/"), F.date_format("o_orderdate", "yyyy-MM-dd")))
    files = table(spark, d, "orders").select(folder.alias("ride_folder"), F.regexp_extract(path, r"\.[^./]*$", 0).alias("suffix"), key.alias("length"), path.alias("path"))
    return aggregates.retention(files, F.to_date(F.lit("1997-01-01"))).drop("ride_date")


@query("""
  c AS (SELECT ride_id, count(*) AS n, count(*) FILTER (value > 50) AS n_selected, count(*) FILTER (seq % 11 > 5) AS n_rated FROM points GROUP BY ride_id),
  m AS (SELECT ride_id, event_type AS source, count(*) AS n_source FROM points GROUP BY ALL)
  SELECT * FROM c JOIN m USING (ride_id)""")
def a13_reviewer_counts(spark, d):
    rows = points(spark, d).select("ride_id", (F.col("value") > 50).alias("selected"), F.when(F.col("seq") % 11 > 5, F.col("seq") % 11).otherwise(0).alias("rating"), F.array("event_type").alias("sources"))
    return aggregates.reviewer_counts(rows)


@query("""
  v AS (SELECT label AS shot_id, vec_id AS frame, embedding AS e, unnest(range(1, 63)) AS i FROM embeddings),
  px AS (SELECT shot_id, frame, abs(e[i]::DOUBLE) / (1 + abs(e[i]::DOUBLE)) AS r, abs(e[i + 1]::DOUBLE) / (1 + abs(e[i + 1]::DOUBLE)) AS g, abs(e[i + 2]::DOUBLE) / (1 + abs(e[i + 2]::DOUBLE)) AS b FROM v),
  lum AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y FROM px),
  ends AS (SELECT shot_id, frame, quantile_cont(y, 0.005) AS lo, greatest(quantile_cont(y, 0.997), quantile_cont(y, 0.005) + 0.05::DOUBLE) AS hi FROM lum GROUP BY ALL),
  lv AS (SELECT shot_id, frame, lo, hi, greatest(0, least(1, (r - lo) / (hi - lo))) AS r, greatest(0, least(1, (g - lo) / (hi - lo))) AS g, greatest(0, least(1, (b - lo) / (hi - lo))) AS b FROM px JOIN ends USING (shot_id, frame)),
  tone AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y FROM lv),
  mask AS (SELECT *, y > 0.15 AND y < 0.85 AS mid, y > 0.15 AND y < 0.85 AND greatest(r, g, b) - least(r, g, b) < 0.12 AS neutral FROM tone),
  n AS (SELECT shot_id, frame, count(*) FILTER (mid) AS n_mid, count(*) FILTER (neutral) >= 5 AS enough FROM mask GROUP BY ALL),
  m AS (SELECT shot_id, frame, any_value(n_mid) AS n_mid, avg(r) FILTER (CASE WHEN enough THEN neutral ELSE mid END) AS mr, avg(g) FILTER (CASE WHEN enough THEN neutral ELSE mid END) AS mg, avg(b) FILTER (CASE WHEN enough THEN neutral ELSE mid END) AS mb FROM mask JOIN n USING (shot_id, frame) GROUP BY ALL),
  gain AS (SELECT shot_id, frame, n_mid, CASE WHEN n_mid = 0 THEN 1 ELSE greatest(0.93, least(1.07, mg / greatest(mr, 1e-4))) END::DOUBLE AS gr, CASE WHEN n_mid = 0 THEN 1 ELSE greatest(0.93, least(1.07, mg / greatest(mb, 1e-4))) END::DOUBLE AS gb FROM m),
  fr AS (SELECT shot_id, frame, any_value(lo) AS lo, any_value(hi) AS hi, any_value(gr) AS gr, any_value(gb) AS gb, CASE WHEN any_value(n_mid) = 0 THEN 0.35 ELSE median(0.2126::DOUBLE * greatest(0, least(1, r * gr)) + 0.7152::DOUBLE * g + 0.0722::DOUBLE * greatest(0, least(1, b * gb))) END::DOUBLE AS med FROM lv JOIN gain USING (shot_id, frame) GROUP BY ALL),
  sh AS (SELECT shot_id, median(lo) AS black, median(hi) AS white, median(gr) AS gain_r, median(gb) AS gain_b, median(med) AS median_luma FROM fr GROUP BY shot_id)
  SELECT shot_id, round(black, 4) AS black, round(white, 4) AS white, round(gain_r, 4) AS gain_r, round(gain_b, 4) AS gain_b, round(median_luma, 4) AS median_luma, round(greatest(-0.6, least(0.6, 0.6 * log2(0.40 / greatest(median_luma, 0.05)))), 3) AS ev FROM sh""")
def a14_shot_balance(spark, d):
    """Embeddings as pixels: a label is a shot, a vector a frame, and three neighbouring values a colour."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("shot_id"), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("px", "x"), "embedding").where("px < 62")
    unit = lambda c: F.abs(c.cast("double")) / (F.lit(1.0) + F.abs(c.cast("double")))
    pixels = v.select("shot_id", "frame", unit(F.col("x")).alias("r"), unit(F.get("embedding", F.col("px") + 1)).alias("g"), unit(F.get("embedding", F.col("px") + 2)).alias("b"))
    return aggregates.shot_balance(pixels, least=5)


@query("""
  m AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM points WINDOW w AS (PARTITION BY ride_id, event_type))
  SELECT ride_id, seq, round(CASE WHEN hi - lo < 1e-6 THEN 4 ELSE 1 + (value - lo) / (hi - lo) * 6 END, 6) AS score FROM m""")
def a15_normalised_scores(spark, d):
    rows = points(spark, d).select("ride_id", "seq", F.col("event_type").alias("source"), F.col("value").alias("score"))
    return rounded(candidates.normalised_scores(rows, rubric=None), 6, "score").select("ride_id", "seq", "score")


@query("""
  t AS (SELECT DISTINCT ride_id, trunc((lon + 180) / 360 * 4096)::INT AS x, trunc((1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096)::INT AS y FROM points)
  SELECT DISTINCT ride_id, x + dx AS tile_x, y + dy AS tile_y FROM t, (SELECT unnest([-1, 0, 1])::INT AS dx), (SELECT unnest([-1, 0, 1])::INT AS dy)""")
def a16_fn31_tile_cover(spark, d):
    return geo.tile_cover(points(spark, d), 12)


@query("SELECT event_type, count(*) AS n, round(stddev_pop(value), 6) AS sd_value, min(value) AS min_value, max(value) AS max_value FROM points GROUP BY event_type")
def a17_score_ranges(spark, d):
    return rounded(aggregates.score_ranges(points(spark, d), ["event_type"], ["value"]), 6, "sd_value")


@query("SELECT ride_id, round(coalesce(max(nullif(speed, 0)) * 2.23694, 40), 6) AS top_speed, coalesce(max(nullif(power, 0)), 500) AS top_power, coalesce(max(heart_rate), 200) AS top_heart_rate, coalesce(max(cadence), 120) AS top_cadence, round((min(lat) + max(lat)) / 2, 9) AS mid_lat, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM points GROUP BY ride_id")
def a20_gauge_ranges(spark, d):
    out = aggregates.gauge_ranges(points(spark, d))
    return rounded(rounded(out, 6, "top_speed"), 9, "mid_lat").select("ride_id", "top_speed", "top_power", "top_heart_rate", "top_cadence", "mid_lat", "min_lat", "max_lat", "min_lon", "max_lon")


# --- candidates and selection ---------------------------------------------------------------------------------------

RUBRIC = "struct<light:int,composition:int,motion:int,scenery:int,subject:int>"


def _pool(spark, d):
    """Candidates from all events: a source by event type, rubrics for vision sources."""
    p = points(spark, d)
    base = p.groupBy("ride_id").agg(F.min("ts").alias("t0"))
    source = F.element_at(F.create_map(*[F.lit(x) for kv in {"view": "telemetry", "click": "gemini", "purchase": "strava", "signup": "label", "error": "openai"}.items() for x in kv]), F.col("event_type"))
    dim = lambda k, m: (F.col("seq") * k % m + 1).cast("int")
    rubric = F.when(source.isin("gemini", "openai"), F.struct(dim(3, 10).alias("light"), dim(5, 10).alias("composition"), dim(7, 10).alias("motion"), dim(11, 9).alias("scenery"), dim(13, 8).alias("subject")))
    t = s.seconds_between(F.col("t0"), F.col("ts")) / 600
    return p.join(base, "ride_id").select("ride_id", "seq", t.alias("t"), F.concat(F.lit("GX01"), F.format_string("%04d", F.col("seq") % 7), F.lit(".MP4")).alias("clip_name"), t.alias("anchor"), (t - 5).alias("video_start"), (t + 5).alias("video_end"), (F.col("value") / 20).alias("score"), source.alias("source"), F.array(source).alias("sources"), rubric.alias("rubric"), F.concat(F.lit("note "), F.col("seq") % 5).alias("notes"), (F.col("seq") % 97 == 0).alias("must_include"))


@query(CLIPS + "," + RUNS + """,
  f AS (SELECT found.*, (epoch_us(peak_ts) - epoch_us(t0)) / 1e6 AS t FROM found JOIN base USING (ride_id)),
  c AS (SELECT f.ride_id, peak_ts, t, any_value(score) AS sc, arg_min(clip_name, (clip_start, clip_name)) AS clip_name, t - min(clip_start) AS anchor FROM f JOIN clips c ON f.ride_id = c.ride_id AND t BETWEEN clip_start AND clip_start + duration_secs GROUP BY f.ride_id, peak_ts, t)
  SELECT c.ride_id, clip_name, round(anchor, 3) AS anchor, round(sc * 10 + CASE WHEN coalesce(power, 0) <> 0 THEN least(power / 50.0, 10) ELSE 0 END + CASE WHEN speed <> 0 THEN least(speed * 2.23694 / 6, 5) ELSE 0 END + CASE WHEN coalesce(heart_rate, 0) <> 0 THEN greatest(0, (heart_rate - 130) / 20.0) ELSE 0 END, 6) AS score FROM c JOIN points p ON p.ride_id = c.ride_id AND p.ts = c.peak_ts""")
def c1_from_highlights(spark, d):
    p = points(spark, d)
    clips, _ = _clips(spark, d)
    base = p.groupBy("ride_id").agg(F.min("ts").alias("t0"))
    found = _runs(spark, d).join(base, "ride_id").withColumn("t", s.seconds_between(F.col("t0"), F.col("peak_ts"))).select("ride_id", "peak_ts", "t", F.col("score").alias("hl_score"))
    placed = joins.first_containing(found, clips, at="t").withColumnRenamed("video_secs", "anchor")
    with_points = placed.join(p.select("ride_id", F.col("ts").alias("peak_ts"), "power", "speed", "heart_rate"), ["ride_id", "peak_ts"])
    out = candidates.from_highlights(with_points, F.col("hl_score"), s.telemetry_score(F.col("power"), F.col("speed"), F.col("heart_rate")))
    return rounded(rounded(out, 3, "anchor"), 6, "score").select("ride_id", "clip_name", "anchor", "score")


@query("""
  e AS (SELECT ride_id, seq, seq % 1000 + 30 AS t, ln(greatest(1, seq % 50)) + value / 50 AS score FROM points WHERE event_type = 'purchase')
  SELECT ride_id, seq, t::DOUBLE AS t, round(score, 6) AS score, greatest(0, 10 - 1.5)::DOUBLE AS video_start FROM e""")
def c2_from_efforts(spark, d):
    rows = points(spark, d).where("event_type = 'purchase'").select("ride_id", "seq", (F.col("seq") % 1000).cast("double").alias("start_secs"), F.lit(60.0).alias("elapsed_secs"), (F.col("seq") % 50).alias("star_count"), F.lit("GX").alias("clip_name"), F.lit(10.0).alias("anchor"), (F.col("value") / 50).alias("tel"))
    return rounded(candidates.from_efforts(rows, F.col("tel")), 6, "score").select("ride_id", "seq", "t", "score", "video_start")


@query("""
  l AS (SELECT ride_id, seq, CASE seq % 4 WHEN 0 THEN 'incident' WHEN 1 THEN 'descent' WHEN 2 THEN 'action' ELSE 'other' END AS type, CASE WHEN seq % 19 = 0 THEN 'MUST have it' ELSE 'fine' END AS notes, value FROM points WHERE event_type = 'signup' AND seq % 5 <> 0)
  SELECT ride_id, seq, round(value / 50 + CASE WHEN lower(notes) LIKE '%must have%' THEN 100 WHEN type = 'incident' THEN 3 WHEN type = 'descent' THEN 1.5 WHEN type = 'action' THEN 1 ELSE 0 END, 6) AS score, lower(notes) LIKE '%must have%' AS must_include FROM l""")
def c3_from_labels(spark, d):
    k = F.col("seq")
    rows = points(spark, d).where("event_type = 'signup'").select("ride_id", "seq", F.when(k % 4 == 0, "incident").when(k % 4 == 1, "descent").when(k % 4 == 2, "action").otherwise("other").alias("type"), F.when(k % 19 == 0, "MUST have it").otherwise("fine").alias("notes"), F.lit(None).cast("boolean").alias("must_include"), F.when(k % 5 != 0, "GX").alias("clip_name"), F.lit(3.0).alias("video_secs"), (F.col("value") / 50).alias("tel"))
    return rounded(candidates.from_labels(rows, F.col("tel")), 6, "score").select("ride_id", "seq", "score", "must_include")


@query("""
  h AS (SELECT ride_id, seq, seq % 101 AS crop_x, CASE seq % 3 WHEN 0 THEN 'landmark' ELSE 'action' END AS ct, (seq * 7 % 10 + 1)::INT AS motion, (seq * 3 % 10 + 1) + (seq * 5 % 10 + 1) + (seq * 7 % 10 + 1) + (seq * 11 % 9 + 1) + (seq * 13 % 8 + 1) AS total, (seq % 15) / 10.0 AS po FROM points WHERE event_type = 'click'),
  b AS (SELECT *, (crop_x - 50) / 50.0 AS bias FROM h)
  SELECT ride_id, seq, round(10 * least(1, po), 6)::DOUBLE AS anchor, round(total / 5.0, 6)::DOUBLE AS score, round(CASE WHEN ct = 'landmark' THEN 0 WHEN abs(bias) > 0.3 THEN bias * (0.5 + 0.5 * greatest(0, motion - 4) / 6.0) ELSE bias END, 6)::DOUBLE AS portrait_crop_bias FROM b""")
def c4_from_hits(spark, d):
    k = F.col("seq")
    rows = _pool(spark, d).where("source = 'gemini'").select("ride_id", "seq", F.lit(0.0).alias("video_start"), F.lit(10.0).alias("video_end"), ((k % 15) / F.lit(10.0)).alias("peak_offset"), "rubric", (k % 101).cast("int").alias("crop_x"), F.when(k % 3 == 0, "landmark").otherwise("action").alias("clip_type"))
    return rounded(candidates.from_hits(rows, "gemini"), 6, "anchor", "score", "portrait_crop_bias").select("ride_id", "seq", "anchor", "score", "portrait_crop_bias")


@query("""
  c AS (SELECT l_orderkey AS ride_id, l_linenumber AS clip_name, l_quantity AS dur, max(l_quantity) OVER (PARTITION BY l_orderkey) AS longest FROM lineitem)
  SELECT ride_id, clip_name, 10 + dur / 2 AS t, round(dur / 10 + 5, 6) AS score FROM c WHERE longest < 30""")
def c5_from_short_clips(spark, d):
    clips = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ride_id"), F.col("l_linenumber").alias("clip_name"), F.lit(10.0).alias("clip_start"), F.col("l_quantity").alias("duration_secs"))
    return rounded(candidates.from_short_clips(clips, F.col("duration_secs") / 10), 6, "score").select("ride_id", "clip_name", "t", "score")


@query()
def c6_c7_fused_candidates(spark, d):
    """Union of all sources, normalised, fused, with agreement boost and blind limit, capped."""
    pool = candidates.united([_pool(spark, d).where(F.col("source") == x) for x in ("label", "telemetry", "strava", "gemini", "openai")])
    return candidates.capped(candidates.fused(candidates.normalised_scores(pool)))


@query("""
  r AS (SELECT ride_id, seq, score, must, count(*) OVER (PARTITION BY ride_id) AS n_all, count(*) FILTER (must) OVER (PARTITION BY ride_id) AS n_must, row_number() OVER (PARTITION BY ride_id, must ORDER BY score DESC, seq) AS rk FROM (SELECT ride_id, seq, value / 20 AS score, seq % 97 = 0 AS must FROM points)),
  st AS (SELECT *, CASE WHEN n_all <= 40 OR must THEN 0 WHEN rk <= greatest(0, 24 - n_must) THEN 1 ELSE 2 END AS stage, CASE WHEN score < 3.5 THEN 0 WHEN score < 6.5 THEN 1 ELSE 2 END AS band FROM r),
  tu AS (SELECT *, row_number() OVER (PARTITION BY ride_id, stage, band ORDER BY score DESC, seq) AS turn FROM st),
  pl AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY stage, CASE stage WHEN 2 THEN turn ELSE rk END, CASE stage WHEN 2 THEN band ELSE 0 END, seq) AS place FROM tu)
  SELECT ride_id, seq FROM pl WHERE place <= 40 OR must""")
def c10_capped(spark, d):
    rows = points(spark, d).select("ride_id", "seq", (F.col("value") / 20).alias("score"), (F.col("seq") % 97 == 0).alias("must_include"))
    return candidates.capped(rows, 40).select("ride_id", "seq")


@query("RECURSIVE" + CLIPS + """,
  pt AS (SELECT ride_id, seq, epoch_us(ts) - epoch_us(t0) AS us, CASE WHEN coalesce(power, 0) <> 0 THEN least(power / 50.0, 10) ELSE 0 END + CASE WHEN speed <> 0 THEN least(speed * 2.23694 / 6, 5) ELSE 0 END + CASE WHEN coalesce(heart_rate, 0) <> 0 THEN greatest(0, (heart_rate - 130) / 20.0) ELSE 0 END AS tel FROM points JOIN base USING (ride_id)),
  have AS (SELECT ride_id, list(us / 1e6) FILTER (event_type = 'signup') AS taken, 12 - count(*) FILTER (event_type = 'signup') AS n_needed FROM points JOIN pt USING (ride_id, seq) GROUP BY ride_id),
  grid AS (SELECT ride_id, unnest(range(0, floor(ride_secs / 3600)::BIGINT + 1)) * 3600 AS t FROM base JOIN have USING (ride_id) WHERE n_needed > 0),
  told AS (SELECT g.ride_id, g.t, arg_min(tel, (abs(us - g.t * 1000000), us, seq)) AS tel FROM grid g JOIN pt USING (ride_id) GROUP BY ALL),
  placed AS (SELECT o.ride_id, t, any_value(tel) AS tel, arg_min(clip_name, (clip_start, clip_name)) AS clip_name, t - min(clip_start) AS anchor FROM told o JOIN clips c ON o.ride_id = c.ride_id AND t BETWEEN clip_start AND clip_start + duration_secs WHERE tel > 0 GROUP BY o.ride_id, t),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY tel DESC, t) AS place FROM placed),
  walk AS (
    SELECT ride_id, 0::BIGINT AS place, coalesce(taken, []) AS times, n_needed AS left_ FROM have WHERE n_needed > 0
    UNION ALL
    SELECT w.ride_id, min(r.place), list_append(any_value(w.times), arg_min(r.t, r.place)), any_value(w.left_) - 1
    FROM walk w JOIN ranked r ON r.ride_id = w.ride_id AND r.place > w.place WHERE w.left_ > 0 AND len([x FOR x IN w.times IF abs(x - r.t) < 7200]) = 0 GROUP BY w.ride_id)
  SELECT ride_id, t::DOUBLE AS t, clip_name, round(anchor, 3) AS anchor, round(greatest(0, anchor - 1.5), 3) AS video_start, round(anchor + 1.5, 3) AS video_end, round(least(0.05 * tel, 0.9), 6) AS score, 'filler' AS source, printf('filler (telemetry score %.1f)', round_even(tel, 1)) AS notes
  FROM ranked JOIN walk USING (ride_id, place)""")
def c11_fillers(spark, d):
    """Fillers up to twelve candidates, beside signups: every hour of the ride with its nearest point's telemetry, on a clip."""
    p = points(spark, d)
    clips, _ = _clips(spark, d)
    base = p.groupBy("ride_id").agg(F.min("ts").alias("t0"))
    taken = p.where("event_type = 'signup'").join(base, "ride_id").select("ride_id", s.seconds_between(F.col("t0"), F.col("ts")).alias("t"))
    needed = p.groupBy("ride_id").agg((12 - F.count_if(F.col("event_type") == "signup")).alias("n_needed"))
    out = candidates.telemetry_fillers(p, clips, taken, needed, step=HOUR, gap=2 * HOUR).drop("sources")
    return rounded(rounded(out, 3, "anchor", "video_start", "video_end"), 6, "score")


@query("""
  p AS (SELECT ride_id, 'GX01' || lpad((seq % 7)::VARCHAR, 4, '0') AS clip, event_type, seq, value / 20 AS score FROM points)
  SELECT ride_id, clip AS stable_id, min(seq) AS seq, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS sources, round(max(score), 6) AS score, arg_min(event_type, seq) AS source FROM p GROUP BY ALL""")
def c12_moments(spark, d):
    rows = points(spark, d).select("ride_id", s.stem(F.concat(F.lit("GX01"), F.format_string("%04d", F.col("seq") % 7), F.lit(".MP4"))).alias("stable_id"), "seq", (F.col("value") / 20).alias("score"), F.col("event_type").alias("source"), F.array("event_type").alias("sources"))
    out = candidates.moments(rows).withColumn("sources", F.array_join("sources", ","))
    return rounded(out, 6, "score").select("ride_id", "stable_id", "seq", "sources", "score", "source")


@query("""
  a AS (SELECT ride_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY ride_id)) / 6e8 AS t, seq FROM points),
  p AS (SELECT ride_id, t AS pt FROM a WHERE seq % 41 = 0)
  SELECT a.ride_id, a.seq, round(least(coalesce(sum(exp(-abs(t - pt) / 60)), 0), 2), 6) AS crowding FROM a LEFT JOIN p USING (ride_id) GROUP BY ALL""")
def s2_crowding(spark, d):
    pool = _pool(spark, d).select("ride_id", "seq", "t")
    return rounded(selection.crowding(pool, pool.where("seq % 41 = 0"), 60.0), 6, "crowding").select("ride_id", "seq", "crowding")


@query("SELECT ride_id, greatest(1, floor(count(*) / 3)::INT) AS n_slots, round(greatest(60, (max(epoch_us(ts)) - min(epoch_us(ts))) / 6e8 / 20), 6) AS tau FROM points GROUP BY ride_id")
def s1_slots_and_decay(spark, d):
    pool = _pool(spark, d)
    tau = selection.decay(pool, F.lit(20))
    n = pool.groupBy("ride_id").agg(selection.slots(F.count(F.lit(1))).alias("n_slots"))
    return rounded(n.join(tau, "ride_id"), 6, "tau")


def _ranked(spark, d):
    w = Window.partitionBy("ride_id").orderBy("t", "seq")
    pool = _pool(spark, d)
    lists = pool.withColumn("pos", F.row_number().over(w)).where("pos <= 40").groupBy("ride_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seq"))), lambda x: (x["seq"] * 31 % 60).cast("string")).alias("positions"))
    return lists, pool


@query("""
  o AS (SELECT ride_id, seq, row_number() OVER (PARTITION BY ride_id ORDER BY ts, seq) AS pos FROM points),
  l AS (SELECT ride_id, seq * 31 % 60 AS position, min(pos) AS at_ FROM o WHERE pos <= 40 GROUP BY ALL),
  f AS (SELECT l.ride_id, o.seq, row_number() OVER (PARTITION BY l.ride_id ORDER BY at_) AS rank0 FROM l JOIN o ON l.ride_id = o.ride_id AND o.pos - 1 = l.position),
  k AS (SELECT *, count(*) OVER (PARTITION BY ride_id) AS n FROM f WHERE rank0 <= 20)
  SELECT ride_id, seq, rank0 FROM k WHERE n * 2 >= 20""")
def s3_absorbed_ranking(spark, d):
    lists, pool = _ranked(spark, d)
    return selection.absorbed(lists, pool, 20)


def _selectable(spark, d):
    lists, pool = _ranked(spark, d)
    ranks = selection.absorbed(lists, pool, 20)
    pool = pool.withColumn("score", F.coalesce(s.rubric_score(F.col("rubric")), F.col("score"))).drop("rubric")
    pool = pool.join(ranks, ["ride_id", "seq"], "left")
    boost = s.label_boost(F.col("sources"), (F.col("seq") % 10).cast("int"), F.lit(0))
    return candidates.capped(pool.withColumn("boost", boost))


#: S-6 to S-8 as recursion: each round takes the free candidate of most worth, or if none is worth it, the one that fills best.
PICKED = """RECURSIVE
  z AS (SELECT ride_id, min(ts) AS t0 FROM points GROUP BY ride_id),
  a AS (SELECT ride_id, seq, (epoch_us(ts) - epoch_us(t0)) / 1e6 / 600 AS t, seq % 97 = 0 AS must, CASE WHEN event_type = 'signup' AND seq % 10 >= 6 THEN 6 ELSE 0 END AS boost,
    CASE WHEN event_type IN ('click', 'error') THEN ((seq * 5 % 10 + 1) + (seq * 7 % 10 + 1) + (seq * 11 % 9 + 1) + (seq * 13 % 8 + 1)) / 4 ELSE value / 20 END AS score FROM points JOIN z USING (ride_id)),
  r AS (SELECT *, count(*) OVER (PARTITION BY ride_id) AS n_all, count(*) FILTER (must) OVER (PARTITION BY ride_id) AS n_must, row_number() OVER (PARTITION BY ride_id, must ORDER BY score DESC, seq) AS rk FROM a),
  st AS (SELECT *, CASE WHEN n_all <= 90 OR must THEN 0 WHEN rk <= greatest(0, 54 - n_must) THEN 1 ELSE 2 END AS stage, CASE WHEN score < 3.5 THEN 0 WHEN score < 6.5 THEN 1 ELSE 2 END AS band FROM r),
  tu AS (SELECT *, row_number() OVER (PARTITION BY ride_id, stage, band ORDER BY score DESC, seq) AS turn FROM st),
  pl AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY stage, CASE stage WHEN 2 THEN turn ELSE rk END, CASE stage WHEN 2 THEN band ELSE 0 END, seq) AS place FROM tu),
  pool AS (SELECT ride_id, seq, t, score, score + boost AS value, must, row_number() OVER w AS pos, greatest(60, (max(t) OVER (PARTITION BY ride_id) - min(t) OVER (PARTITION BY ride_id)) / 20) AS tau FROM pl WHERE place <= 90 OR must WINDOW w AS (PARTITION BY ride_id ORDER BY t, seq)),
  walk AS (
    SELECT ride_id, coalesce(list(t ORDER BY pos) FILTER (must), []) AS times, coalesce(list(seq ORDER BY pos) FILTER (must), []) AS used, 1 AS phase FROM pool GROUP BY ride_id
    UNION ALL
    SELECT ride_id, list_append(times, CASE WHEN worth THEN one.t ELSE two.t END), list_append(used, CASE WHEN worth THEN one.seq ELSE two.seq END), CASE WHEN worth THEN 1 ELSE 2 END FROM (
      SELECT ride_id, any_value(times) AS times, any_value(used) AS used, any_value(phase) = 1 AND max(eff) >= 0 AS worth, arg_min(struct_pack(t := t, seq := seq), (-eff, pos)) AS one, arg_min(struct_pack(t := t, seq := seq), (-fill, pos)) AS two FROM (
        SELECT p.*, times, used, phase, value - 6 * least(coalesce(list_sum([exp(-abs(p.t - x) / tau) FOR x IN times]), 0), 2) AS eff, coalesce(list_min([abs(p.t - x) FOR x IN times]), 1e9) + 30 * score AS fill
        FROM walk w JOIN pool p USING (ride_id) WHERE len(used) < 20 AND NOT list_contains(used, p.seq) AND len([x FOR x IN times IF abs(p.t - x) < 3]) = 0) GROUP BY ride_id)),
  last_ AS (SELECT ride_id, arg_max(used, len(used)) AS used FROM walk GROUP BY ride_id),
  picked AS (SELECT ride_id, seq, t, score, (row_number() OVER (PARTITION BY ride_id ORDER BY t, seq))::INT AS place FROM last_ JOIN pool USING (ride_id) WHERE list_contains(used, seq) QUALIFY place <= 20)"""


@query(PICKED + " SELECT ride_id, layout, seq, round(t, 9) AS t, round(score, 6) AS score, place FROM picked, (VALUES ('landscape'), ('portrait')) l(layout)")
def s6_s8_selected(spark, d):
    """Greedy selection for two layouts."""
    pool = _selectable(spark, d)
    both = pool.withColumn("layout", F.explode(F.array(F.lit("landscape"), F.lit("portrait"))))
    return rounded(rounded(selection.selected(both, 20, layout="layout"), 9, "t"), 6, "score")


#: The selection that starts from ranked candidates: these in order of worth, gaps backfilled, then as in PICKED.
RANKED = PICKED + """,
  o AS (SELECT ride_id, seq, row_number() OVER (PARTITION BY ride_id ORDER BY ts, seq) AS pos FROM points),
  l AS (SELECT ride_id, seq * 31 % 60 AS position, min(pos) AS at_ FROM o WHERE pos <= 40 GROUP BY ALL),
  f AS (SELECT l.ride_id, o.seq, row_number() OVER (PARTITION BY l.ride_id ORDER BY at_) AS rank0 FROM l JOIN o ON l.ride_id = o.ride_id AND o.pos - 1 = l.position),
  k AS (SELECT *, count(*) OVER (PARTITION BY ride_id) AS n FROM f WHERE rank0 <= 20),
  rk AS (SELECT p.*, row_number() OVER (PARTITION BY p.ride_id ORDER BY value DESC, pos) AS i FROM pool p JOIN k USING (ride_id, seq) WHERE n * 2 >= 20),
  story AS (
    SELECT ride_id, coalesce(list(t ORDER BY pos) FILTER (must), []) AS times, coalesce(list(seq ORDER BY pos) FILTER (must), []) AS used, 0::BIGINT AS i FROM pool GROUP BY ride_id
    UNION ALL
    SELECT ride_id, CASE WHEN ok THEN list_append(times, t) ELSE times END, CASE WHEN ok THEN list_append(used, seq) ELSE used END, i FROM (
      SELECT w.ride_id, times, used, r.i, r.t, r.seq, NOT list_contains(used, r.seq) AND len([x FOR x IN times IF abs(r.t - x) < 3]) = 0 AND value - 6 * least(coalesce(list_sum([exp(-abs(r.t - x) / tau) FOR x IN times]), 0), 2) >= 0 AS ok
      FROM story w JOIN rk r ON r.ride_id = w.ride_id AND r.i = w.i + 1)),
  told AS (SELECT ride_id, arg_max(times, i) AS times, arg_max(used, i) AS used, max(i) > 0 AS by_rank FROM story GROUP BY ride_id),
  patched AS (
    SELECT ride_id, times, used, by_rank FROM told
    UNION ALL
    SELECT ride_id, list_append(any_value(times), arg_min(t, (-(b - a), a, -score, pos))), list_append(any_value(used), arg_min(seq, (-(b - a), a, -score, pos))), true FROM (
      SELECT p.*, times, used, list_max([x FOR x IN times IF x <= p.t]) AS a, list_min([x FOR x IN times IF x > p.t]) AS b FROM patched w JOIN pool p USING (ride_id) WHERE by_rank AND len(used) BETWEEN 2 AND 19 AND NOT list_contains(used, p.seq))
    WHERE b - a > 180 AND t >= a + 30 AND t <= b - 30 GROUP BY ride_id),
  start_ AS (SELECT ride_id, arg_max(times, len(used)) AS times, arg_max(used, len(used)) AS used FROM patched GROUP BY ride_id),
  walk2 AS (
    SELECT ride_id, times, used, 1 AS phase FROM start_
    UNION ALL
    SELECT ride_id, list_append(times, CASE WHEN worth THEN one.t ELSE two.t END), list_append(used, CASE WHEN worth THEN one.seq ELSE two.seq END), CASE WHEN worth THEN 1 ELSE 2 END FROM (
      SELECT ride_id, any_value(times) AS times, any_value(used) AS used, any_value(phase) = 1 AND max(eff) >= 0 AS worth, arg_min(struct_pack(t := t, seq := seq), (-eff, pos)) AS one, arg_min(struct_pack(t := t, seq := seq), (-fill, pos)) AS two FROM (
        SELECT p.*, times, used, phase, value - 6 * least(coalesce(list_sum([exp(-abs(p.t - x) / tau) FOR x IN times]), 0), 2) AS eff, coalesce(list_min([abs(p.t - x) FOR x IN times]), 1e9) + 30 * score AS fill
        FROM walk2 w JOIN pool p USING (ride_id) WHERE len(used) < 20 AND NOT list_contains(used, p.seq) AND len([x FOR x IN times IF abs(p.t - x) < 3]) = 0) GROUP BY ride_id)),
  last2 AS (SELECT ride_id, arg_max(used, len(used)) AS used FROM walk2 GROUP BY ride_id),
  picked2 AS (SELECT ride_id, seq, t, score, (row_number() OVER (PARTITION BY ride_id ORDER BY t, seq))::INT AS place FROM last2 JOIN pool USING (ride_id) WHERE list_contains(used, seq) QUALIFY place <= 20)"""


@query(RANKED + " SELECT ride_id, seq, round(t, 9) AS t, round(score, 6) AS score, place FROM picked2")
def s4_s5_ranked_selection(spark, d):
    return rounded(rounded(selection.selected(_selectable(spark, d), 20, ranked=True), 9, "t"), 6, "score")


@query(PICKED + " SELECT pool.ride_id, pool.seq, CASE WHEN picked.seq IS NULL THEN 'pending' ELSE 'auto' END AS status FROM pool LEFT JOIN picked ON pool.ride_id = picked.ride_id AND pool.seq = picked.seq")
def s9_auto_status(spark, d):
    pool = _selectable(spark, d)
    rows = joins.marked_selected(pool.select("ride_id", "seq"), selection.selected(pool, 20), ["ride_id", "seq"])
    return rows.select("ride_id", "seq", F.when(F.col("selected"), "auto").otherwise("pending").alias("status"))


@query(RANKED + " SELECT ride_id, count(g.seq) AS n_greedy, count(r.seq) AS n_ranked, count(*) FILTER (g.seq IS NOT NULL AND r.seq IS NOT NULL) AS n_both FROM picked g FULL JOIN picked2 r USING (ride_id, seq) GROUP BY ride_id")
def s10_selection_overlap(spark, d):
    return selection.selection_overlap(_selectable(spark, d), 20)


@query("""
  m AS (SELECT ride_id, seq, row_number() OVER (PARTITION BY ride_id ORDER BY seq) AS slot, row_number() OVER (PARTITION BY ride_id ORDER BY seq DESC) = 1 AS last_, seq % 30 AS vs, seq % 30 + seq % 9 AS ve, seq % 30 + 1 AS anc FROM points WHERE event_type = 'purchase'),
  a AS (SELECT *, 3.0 + CASE WHEN last_ THEN 2 ELSE 0 END AS trim_ FROM m),
  c AS (SELECT *, greatest(vs, anc - trim_ / 2) AS s, least(ve, anc + trim_ / 2) AS e FROM a),
  k AS (SELECT *, CASE WHEN e - s < trim_ THEN greatest(0, anc - trim_ / 2) ELSE s END AS cs, CASE WHEN e - s < trim_ THEN anc + trim_ / 2 ELSE e END AS ce FROM c)
  SELECT ride_id, seq, slot, cs::DOUBLE AS cut_start, (CASE WHEN slot = 1 THEN greatest(ce - cs, 4) ELSE ce - cs END)::DOUBLE AS cut_secs FROM k""")
def s11_fn22_cut_list(spark, d):
    k = (F.col("seq") % 30).cast("double")
    rows = points(spark, d).where("event_type = 'purchase'").select("ride_id", "seq", k.alias("video_start"), (k + F.col("seq") % 9).alias("video_end"), (k + 1).alias("anchor"), F.lit(None).cast("double").alias("final_trim_secs"))
    return selection.cut_list(rows, intro=4.0, t="seq").select("ride_id", "seq", "slot", "cut_start", "cut_secs")


# --- ranker and scoring ---------------------------------------------------------------------------------------------


def _training(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.col("source").alias("ride_id"), F.col("quality").alias("selected"), F.log1p(F.length(text).cast("double")).alias("log_chars"), (F.length(F.regexp_replace(text, "[^A-Z]", "")) / (F.length(text) + 1)).alias("upper"), (F.length(F.regexp_replace(text, "[^!|#$%&*]", "")) / (F.length(text) + 1)).alias("marks"))


@query()
def ml3_ml5_ranker(spark, d):
    """A ranker of labelled documents, trained on all of them, and its score of each."""
    rows = _training(spark, d)
    model = ranker.train(rows, ["log_chars", "upper", "marks"])
    return rounded(ranker.predicted(rows, model or {"intercept": 0.0, "weights": {}}), 6, "learned_score").select("doc_id", "selected", "learned_score")


@query("SELECT count(*) AS n, sum(quality)::BIGINT AS n_positive, round_even(avg(quality), 3) AS rate, count(DISTINCT source) AS n_keys, greatest(0, 100 - count(*)) AS remaining FROM documents JOIN labels USING (doc_id)")
def ml6_training_status(spark, d):
    return ranker.status(_training(spark, d))


@query("""
  p AS (SELECT ride_id, seq, event_type, (seq % 11)::DOUBLE AS v, (seq % 7)::DOUBLE AS a, '(' || (seq % 40) || ' stars)' AS notes FROM points)
  SELECT ride_id, seq, v AS visual, a AS action, v * a AS visual_x_action, (event_type = 'view')::INT::DOUBLE AS has_telemetry, 1.0::DOUBLE AS source_count, round(ln(greatest(1, seq % 40)), 6) AS strava_stars FROM p""")
def ml1_features(spark, d):
    rows = points(spark, d).select("ride_id", "seq", (F.col("value") / 20).alias("score"), F.array(F.when(F.col("event_type") == "view", "telemetry").otherwise("clip")).alias("sources"), F.concat(F.lit("("), F.col("seq") % 40, F.lit(" stars)")).alias("notes"))
    out = ranker.features(rows, F.col("seq") % 11, F.col("seq") % 7)
    return rounded(out, 6, "strava_stars").select("ride_id", "seq", "visual", "action", "visual_x_action", "has_telemetry", "source_count", "strava_stars")


def _frame_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for a model: scores from the frame's time."""
    n = (batch["t"].astype(int) // 10).to_numpy()
    if n[0] % 17 == 16:
        raise ValueError("refused")
    return pd.DataFrame({"frame_index": range(len(n)), "visual": n % 5 + 1, "action": n // 5 % 5 + 1})


def _window_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    n = int(batch["t"].iloc[0])
    return pd.DataFrame([{"light": n % 10 + 1, "composition": n % 9 + 1, "motion": n % 8 + 1, "scenery": n % 7 + 1, "subject": n % 6 + 1, "peak_offset": 0.5, "crop_x": n % 101, "clip_type": "action"}])


def _scan_input(spark, d):
    clips = table(spark, d, "customer").select("c_name", (F.abs("c_acctbal") % 300 + 30).alias("duration_secs")).withColumnRenamed("c_name", "clip_name")
    frames = clips.select("clip_name", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration_secs") / 10).cast("int"))).alias("i")).select("clip_name", (F.col("i") * 10.0).alias("t"))
    return clips, frames


@query()
def bi1_bi6_scan(spark, d):
    """Two scoring passes over all clips with deterministic stand-ins for models; one row per rated window."""
    clips, frames = _scan_input(spark, d)
    return scoring.scan(clips, frames, _frame_scorer, _window_scorer)[0]


@query()
def bi4_failure_tally(spark, d):
    clips, frames = _scan_input(spark, d)
    return scoring.tally(scoring.coarse_scores(frames, _frame_scorer), clips)


# --- scalar expressions ---------------------------------------------------------------------------------------------


@query("""
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 2.23694, 6) AS mph, round(l_extendedprice / 1609.344, 6) AS mi, round(l_quantity * 3.28084, 6) AS ft,
    CASE WHEN l_extendedprice >= 3600 THEN format('{}:{:02d}:{:02d}', floor(l_extendedprice)::BIGINT // 3600, floor(l_extendedprice)::BIGINT % 3600 // 60, floor(l_extendedprice)::BIGINT % 60) ELSE format('{}:{:02d}', floor(l_extendedprice)::BIGINT // 60, floor(l_extendedprice)::BIGINT % 60) END AS clock,
    format('{}:{:02d}', floor(l_extendedprice)::BIGINT // 3600, floor(l_extendedprice)::BIGINT % 3600 // 60) AS hm,
    round(CASE WHEN l_tax * 10 < 0.5 THEN 0 ELSE l_quantity / (l_tax * 10) * 100 END, 6) AS grade, upper(strftime(l_shipdate, '%b %d, %Y')) AS title_date
  FROM lineitem""")
def fn_units_and_time(spark, d):
    li = table(spark, d, "lineitem")
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    r6 = lambda c: F.round(c, 6)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(s.mph(q)).alias("mph"), r6(s.miles(x)).alias("mi"), r6(s.feet(q)).alias("ft"), s.clock(x).alias("clock"), s.hours_minutes(x).alias("hm"), r6(s.gradient(q, F.col("l_tax") * 10)).alias("grade"), s.title_date(F.col("l_shipdate")).alias("title_date"))


@query("""
  k AS (SELECT ride_id, seq, CASE WHEN seq % 3 = 0 THEN (seq % 11)::INT END AS v, CASE WHEN seq % 5 = 0 THEN (seq % 7)::INT END AS a, (seq % 2 = 0) AS rub, (seq % 10)::INT AS c, (seq * 3 % 10)::INT AS m, (seq * 7 % 10)::INT AS sc, (seq * 9 % 10)::INT AS su, seq % 11 AS rating FROM points)
  SELECT ride_id, seq, CASE WHEN v IS NOT NULL OR a IS NOT NULL THEN coalesce(v, 0) WHEN rub THEN round_even((c + sc) / 2, 0)::INT ELSE 5 END AS visual, CASE WHEN v IS NOT NULL OR a IS NOT NULL THEN coalesce(a, 0) WHEN rub THEN round_even((m + su) / 2, 0)::INT ELSE 6 END AS action,
    CASE WHEN rub THEN round((c + m + sc + su) / 4, 6) END AS rubric_score, (CASE WHEN rating BETWEEN 1 AND 5 THEN (rating - 3) * 2 WHEN rating > 5 THEN rating - 5.5 ELSE 0 END)::DOUBLE AS adjust, CASE WHEN seq % 4 < 2 THEN v * 2 ELSE v END AS scaled
  FROM k""")
def fn_ratings(spark, d):
    k = F.col("seq")
    i = lambda c: c.cast("int")
    rows = points(spark, d).select("ride_id", "seq", F.when(k % 3 == 0, i(k % 11)).alias("v"), F.when(k % 5 == 0, i(k % 7)).alias("a"), F.when(k % 2 == 0, F.struct(F.lit(1).alias("light"), i(k % 10).alias("composition"), i(k * 3 % 10).alias("motion"), i(k * 7 % 10).alias("scenery"), i(k * 9 % 10).alias("subject"))).alias("rubric"))
    visual, action = s.visual_action(F.col("v"), F.col("a"), F.col("rubric"), F.lit(5), F.lit(6))
    return rows.select("ride_id", "seq", visual.alias("visual"), action.alias("action"), F.round(s.rubric_score(F.col("rubric")), 6).alias("rubric_score"), s.rating_adjustment(k % 11).alias("adjust"), s.label_on_new_scale(F.col("v"), F.when(k % 4 < 2, F.when(k % 4 == 0, 1)).otherwise(2)).alias("scaled"))


@query("""
  k AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '.MP4' ELSE 'GX' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '.MP4' END AS f, c_mktsegment || '/' || c_name || ' v' AS model, c_acctbal AS x, 'US ' || c_custkey AS ref FROM customer)
  SELECT c_custkey, regexp_replace(f, '\\.MP4$', '') || '@' || round_even(abs(x), 0)::BIGINT AS stable_id, CASE WHEN c_custkey % 3 = 0 THEN regexp_replace(f, '\\.MP4$', '') ELSE f[5:8] END AS recording, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE f[3:4]::INT END AS chapter,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'GL' || f[3:8] || '.LRV' END AS proxy,
    trim(regexp_replace(regexp_replace(model, '[^A-Za-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '-.') || '_' || sha1(model)[1:8] AS model, c_custkey::VARCHAR AS clean_ref, md5(printf('%.4f,%.4f', x, x / 3)) AS geo_key
  FROM k""")
def fn_names(spark, d):
    c = F.col("c_custkey")
    f = F.when(c % 3 == 0, F.concat("c_name", F.lit(".MP4"))).otherwise(F.concat(F.lit("GX"), F.lpad((c % 100).cast("string"), 2, "0"), F.lpad((c % 10000).cast("string"), 4, "0"), F.lit(".MP4")))
    rows = table(spark, d, "customer").select("c_custkey", f.alias("f"), F.concat("c_mktsegment", F.lit("/"), "c_name", F.lit(" v")).alias("m"), "c_acctbal")
    recording, number = s.chapter(F.col("f"))
    return rows.select("c_custkey", s.stable_id(F.col("f"), F.abs("c_acctbal")).alias("stable_id"), recording.alias("recording"), number.alias("chapter"), s.proxy_name(F.col("f")).alias("proxy"), s.sanitised_model(F.col("m")).alias("model"), s.clean_ref(F.concat(F.lit("US "), "c_custkey")).alias("clean_ref"), s.geo_key(F.col("c_acctbal"), F.col("c_acctbal") / 3).alias("geo_key"))


@query("""SELECT ride_id, seq, CASE seq % 5 WHEN 4 THEN '{}' ELSE regexp_replace(props, '\\s', '', 'g') END AS parsed, seq % 5 <> 4 AS ok FROM points""")
def fn10_json_repair(spark, d):
    k = F.col("seq") % 5
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.regexp_replace("props", r"\}", ",}")).when(k == 3, F.concat(F.lit("well: "), "props", F.lit(" ok"))).otherwise("{broken")
    value, ok = s.parsed_json(text)
    return points(spark, d).select("ride_id", "seq", value.alias("parsed"), ok.alias("ok"))


@query("""
  SELECT ride_id, seq, round(7917.6 * asin(sqrt(sin(radians(40.3 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(40.3)) * sin(radians(-73.9 - lon) / 2) ** 2)), 6) AS haversine,
    CASE WHEN value / 100 <= 0.55 THEN 0 WHEN value / 100 <= 0.75 THEN 1 WHEN value / 100 <= 0.9 THEN 2 ELSE 3 END AS zone, round_even(1.45 * (seq % 300), 0)::INT AS power_at, round_even(0.87 * (150 + seq % 60), 0)::INT AS hr_at,
    round(CASE WHEN coalesce(power, 0) <> 0 THEN least(power / 50.0, 10) ELSE 0 END + CASE WHEN speed <> 0 THEN least(speed * 2.23694 / 6, 5) ELSE 0 END + CASE WHEN coalesce(heart_rate, 0) <> 0 THEN greatest(0, (heart_rate - 130) / 20.0) ELSE 0 END, 6) AS telemetry
  FROM points""")
def fn_geo_zones_telemetry(spark, d):
    rows = points(spark, d)
    power, hr = s.thresholds(F.col("seq") % 300, 150 + F.col("seq") % 60)
    return rows.select("ride_id", "seq", F.round(s.haversine_miles(F.col("lat"), F.col("lon"), F.lit(40.3), F.lit(-73.9)), 6).alias("haversine"), s.zone(F.col("value") / 100, [0.55, 0.75, 0.9, 1.0]).alias("zone"), power.alias("power_at"), hr.alias("hr_at"), F.round(s.telemetry_score(F.col("power"), F.col("speed"), F.col("heart_rate")), 6).alias("telemetry"))


@query("SELECT ride_id, round(min(lat) - 0.25 / 69, 9) AS south, round(min(lon) - 0.25 / (69 * greatest(0.01, cos(radians((min(lat) + max(lat)) / 2)))), 9) AS west, round(max(lat) + 0.25 / 69, 9) AS north, round(max(lon) + 0.25 / (69 * greatest(0.01, cos(radians((min(lat) + max(lat)) / 2)))), 9) AS east FROM points GROUP BY ride_id")
def fn34_padded_box(spark, d):
    b = points(spark, d).groupBy("ride_id").agg(F.min("lat").alias("a"), F.min("lon").alias("b"), F.max("lat").alias("c"), F.max("lon").alias("e"))
    box = s.padded_box(F.col("a"), F.col("b"), F.col("c"), F.col("e"))
    return b.select("ride_id", *[F.round(v, 9).alias(n) for v, n in zip(box, ("south", "west", "north", "east"), strict=True)])


@query("""
  k AS (SELECT ride_id, list_sort(list(round_even(value, 0)::BIGINT)) AS v FROM points GROUP BY ride_id)
  SELECT ride_id, sha1(array_to_string(v, ','))[1:8] AS fingerprint FROM k""")
def fn11_times_fingerprint(spark, d):
    return points(spark, d).groupBy("ride_id").agg(F.collect_list("value").alias("v")).select("ride_id", s.times_fingerprint(F.col("v")).alias("fingerprint"))


# --- sources --------------------------------------------------------------------------------------------------------


@query("""
  SELECT ride_id, seq, ts, round((seq * 1000003 % 1000000000) * 180.0 / 2147483648, 9) AS lat, CASE WHEN seq % 3 = 0 THEN speed ELSE value END AS speed, CASE WHEN seq % 4 = 0 OR altitude IS NULL OR altitude = 0 THEN value ELSE altitude END AS altitude FROM points WHERE seq % 10 <> 0""")
def src1_normalised_points(spark, d):
    k = F.col("seq")
    records = points(spark, d).select("ride_id", "seq", F.when(k % 10 != 0, F.col("ts")).alias("timestamp"), (k * 1000003 % 1000000000).alias("position_lat"), k.alias("position_long"), F.when(k % 3 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("enhanced_speed"), "speed", F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("altitude")).alias("enhanced_altitude"), F.col("value").alias("altitude"), "power", "heart_rate", "cadence", F.lit(None).cast("int").alias("temperature"), "distance")
    return rounded(readers.normalised_points(records), 9, "lat").select("ride_id", "seq", "ts", "lat", "speed", "altitude")


@query("""
  a AS (SELECT ride_id, bool_or(power IS NOT NULL) AS has_power, bool_or(cadence IS NOT NULL) AS has_cadence FROM points GROUP BY ride_id),
  b AS (SELECT ride_id, arg_min_null(CASE WHEN coalesce(altitude, 0) <> 0 THEN altitude ELSE value END, seq) AS max_speed FROM points GROUP BY ride_id)
  SELECT * FROM a JOIN b USING (ride_id)""")
def src2_src3_sessions_and_sensors(spark, d):
    p = points(spark, d)
    none = F.lit(None).cast("double")
    first = readers.first_session(p.select("ride_id", "seq", none.alias("total_elapsed_time"), none.alias("total_timer_time"), none.alias("total_distance"), none.alias("enhanced_avg_speed"), none.alias("avg_speed"), F.col("altitude").alias("enhanced_max_speed"), F.col("value").alias("max_speed")))
    return readers.sensors(p).join(first.select("ride_id", "max_speed"), "ride_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS shift_secs FROM lineitem")
def src5_stitched_chapters(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return readers.stitched(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"], "l_quantity")


@query("""
  c AS (SELECT ride_id, seq, ts, (seq % 97)::DOUBLE AS secs, row_number() OVER (PARTITION BY ride_id ORDER BY seq) AS rn FROM points),
  n AS (SELECT *, (rn - 1) // 3 AS rec, (rn - 1) % 3 + 1 AS ch FROM c),
  s AS (SELECT *, coalesce(sum(secs) OVER (PARTITION BY ride_id, rec ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM n)
  SELECT ride_id, seq, ch::BIGINT AS chapter, ts + to_microseconds((shift * 1e6)::BIGINT) AS start_ts FROM s""")
def src5_chapter_starts(spark, d):
    """Events in threes as chapters of a recording, named as a camera names them: its numbers have four digits and begin again on
    the next card, so a card of 9,000 chapters is a key of its own."""
    rn = F.row_number().over(Window.partitionBy("ride_id").orderBy("seq"))
    rows = points(spark, d).withColumn("rn", rn - 1).withColumn("card", F.floor(F.col("rn") / 9000))
    name = F.format_string("GX%02d%04d.MP4", F.col("rn") % 3 + 1, F.floor(F.col("rn") % 9000 / 3))
    clips = rows.select("ride_id", F.concat_ws(":", "ride_id", "card").alias("card"), "seq", name.alias("clip_name"), F.col("ts").cast("timestamp_ntz").alias("creation_time"), (F.col("seq") % 97).cast("double").alias("duration_secs"))
    return readers.stitched_chapters(clips, "card").select("ride_id", "seq", F.col("chapter").cast("long").alias("chapter"), "start_ts")


@query("""
  e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'R' AS starred, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS any_starred, CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 77 END AS cached FROM lineitem)
  SELECT l_orderkey, count(*) AS n, sum(coalesce(cached, CASE WHEN starred THEN 100 ELSE 0 END))::BIGINT AS stars FROM e WHERE starred OR NOT any_starred GROUP BY l_orderkey""")
def src6_src7_efforts_with_stars(spark, d):
    li = table(spark, d, "lineitem")
    order = li.groupBy(F.col("l_orderkey").alias("activity_id")).agg(F.lit("2024-01-01T00:00:00Z").alias("start_date"), F.collect_list(F.struct(F.lit("2024-01-01T00:01:00Z").alias("start_date"), F.col("l_quantity").alias("elapsed_time"), F.struct(F.col("l_partkey").alias("id"), F.lit("s").alias("name"), (F.col("l_returnflag") == "R").alias("starred"), F.lit(1.0).alias("distance")).alias("segment"))).alias("segment_efforts"))
    cache = li.select(F.col("l_partkey").alias("segment_id")).distinct().where("segment_id % 2 = 0").withColumn("star_count", (F.col("segment_id") % 77).cast("int"))
    counted, _ = readers.with_star_counts(readers.segment_efforts(order), cache)
    return counted.groupBy(F.col("activity_id").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("star_count").cast("long").alias("stars"))


@query("""
  m AS (SELECT ride_id, seq, CASE WHEN ride_id % 2 = 0 THEN CASE seq % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'auto' ELSE 'rejected' END END AS status, value, CASE WHEN seq % 4 = 0 THEN value + 1 END AS o FROM points)
  SELECT ride_id, seq, CASE WHEN status IS NOT NULL THEN coalesce(o, value) ELSE value END AS anchor FROM m WHERE status IS NULL OR status IN ('approved', 'auto')""")
def src11_selection_input(spark, d):
    k = F.col("seq")
    rows = points(spark, d).select("ride_id", "seq", F.when(F.col("ride_id") % 2 == 0, F.when(k % 3 == 0, "approved").when(k % 3 == 1, "auto").otherwise("rejected")).alias("status"), F.col("value").alias("anchor_video_secs"), F.when(k % 4 == 0, F.col("value") + 1).alias("user_anchor_override"), F.lit(0.0).alias("video_start"), F.lit(1.0).alias("video_end"), F.lit(None).cast("array<double>").alias("user_in_out"))
    return readers.selection_input(rows).select("ride_id", "seq", F.col("anchor_video_secs").alias("anchor"))


@query("SELECT ride_id, seq, round(lat * 1e7 / 1e7, 7) AS lat, TIMESTAMP '2000-01-01' + to_microseconds((seq % 9000)::BIGINT * 86400000000 + (seq % 86400) * 1000) AS ts FROM points")
def src16_scaled_gps(spark, d):
    n = F.lit(1.0)
    raw = points(spark, d).select("ride_id", F.col("ride_id").alias("clip_name"), F.col("seq").alias("idx"), (F.col("lat") * 1e7).alias("lat"), F.lit(1e7).alias("lat_scale"), (F.col("seq") % 9000).alias("days"), (F.col("seq") % 86400).alias("secs"), F.lit(1000.0).alias("secs_scale"), *[x.alias(c) for c in ("lon", "alt", "speed_mps", "dop") for x in (n,)], *[n.alias(f"{c}_scale") for c in ("lon", "alt", "speed_mps", "dop")], F.lit(3).alias("fix"))
    return rounded(readers.scaled_gps(raw), 7, "lat").select(F.col("clip_name").alias("ride_id"), F.col("idx").alias("seq"), "lat", "ts")


@query("""
  h AS (SELECT ride_id, seq, CASE WHEN seq % 2 = 0 THEN value END AS v1, CASE WHEN seq % 3 = 0 THEN value + 1 END AS v2, event_type AS f FROM points)
  SELECT ride_id, seq, coalesce(v1, v2, 0) AS position FROM h WHERE seq % 6 IN (0, 1)""")
def src9_fn36_cached_hits(spark, d):
    """Files of six names, two of which are of the model."""
    k = F.col("seq")
    names = ["c/GX_v3_mabc.json", "GX_v3_mabc_l7.json", "GX_v3_mabcd.json", "GX_abc_v3.json", "mabc.json", "GX_mabc/other.json"]
    hits = points(spark, d).select("ride_id", "seq", F.get(F.array(*map(F.lit, names)), (k % 6).cast("int")).alias("file"), F.lit("GX").alias("clip_name"), F.when(k % 2 == 0, F.col("value")).alias("anchor_video_secs"), F.when(k % 3 == 0, F.col("value") + 1).alias("video_secs"))
    return readers.cached_hits(hits, "abc").select("ride_id", "seq", "position")


@query("""
  m AS (SELECT ride_id, seq % 300 AS ride_sec, seq AS pos FROM points)
  SELECT ride_id, ride_sec, max(pos) AS file FROM m GROUP BY ALL""")
def src19_snk8_frame_files(spark, d):
    rows = points(spark, d).groupBy("ride_id").agg(F.transform(F.array_sort(F.collect_list("seq")), lambda x: F.struct((x % 300).alias("ride_secs"), x.cast("string").alias("file"))).alias("frames"))
    return readers.frame_files(rows).select("ride_id", "ride_sec", F.col("file").cast("long").alias("file"))


# --- sources and names, continued -----------------------------------------------------------------------------------


@query("""
  o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS a, o_orderdate + INTERVAL 1 DAY AS b FROM orders)
  SELECT 'GX' || o_orderkey || '.MP4' AS clip_name, CASE WHEN a IS NULL AND o_orderkey % 2 = 0 THEN NULL ELSE coalesce(a, b) END AS creation_time, (o_orderkey % 100)::DOUBLE AS duration_secs, (1000 + o_orderkey % 9)::INT AS width, round(60000 / 1001, 6) AS fps FROM o""")
def src4_clip_catalogue(spark, d):
    k = F.col("o_orderkey")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tags = lambda c: F.struct(c.alias("creation_time"))
    stream = lambda kind, made: F.struct(F.lit(kind).alias("codec_type"), (1000 + k % 9).cast("int").alias("width"), F.lit(720).alias("height"), F.lit("60000/1001").alias("r_frame_rate"), tags(made).alias("tags"))
    none = F.lit(None).cast("string")
    probes = table(spark, d, "orders").select(
        F.concat(F.lit("/r/GX"), k, F.lit(".MP4")).alias("path"),
        F.struct((k % 100).cast("string").alias("duration"), tags(F.when(k % 3 != 0, iso(F.col("o_orderdate")))).alias("tags")).alias("format"),
        F.array(stream("audio", iso(F.col("o_orderdate"))), stream("video", none), stream("video", F.when(k % 2 != 0, iso(F.expr("o_orderdate + interval 1 day"))))).alias("streams"),
    )
    return rounded(readers.clip_catalogue(probes), 6, "fps").select("clip_name", "creation_time", "duration_secs", "width", "fps")


@query("SELECT ride_id, seq, CASE WHEN seq % 3 < 2 THEN (seq % 6)::INT * 2 ELSE (seq % 6)::INT END AS visual, 2 AS scale_version FROM points WHERE event_type = 'click'")
def src8_fn4_upgraded_labels(spark, d):
    k = F.col("seq")
    rows = points(spark, d).where("event_type = 'click'").select("ride_id", "seq", (k % 6).cast("int").alias("visual"), (k % 5).cast("int").alias("action"), F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, 1).otherwise(2).cast("int").alias("scale_version"))
    return readers.upgraded_labels(rows).select("ride_id", "seq", "visual", "scale_version")


@query("""
  SELECT ride_id, seq, CASE WHEN seq % 2 = 0 THEN 'id' || seq ELSE 'GX' || seq % 7 || '@' || round_even(value, 0)::BIGINT END AS id, CASE WHEN seq % 3 = 0 THEN 'a,b' ELSE event_type END AS sources, 'pending' AS status, 0 AS rating, '' AS notes FROM points""")
def src10_src12_lenient_moments(spark, d):
    k = F.col("seq")
    none = F.lit(None)
    rows = points(spark, d).select("ride_id", "seq", F.when(k % 2 == 0, F.concat(F.lit("id"), k)).alias("id"), F.concat(F.lit("GX"), k % 7, F.lit(".MP4")).alias("clip_name"), F.lit(None).cast("double").alias("anchor_video_secs"), (F.col("value") - 1).alias("video_start"), (F.col("value") + 1).alias("video_end"), F.col("event_type").alias("source"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("sources"), none.cast("string").alias("status"), none.cast("int").alias("rating"), none.cast("string").alias("notes"), none.cast("double").alias("portrait_crop_bias"))
    out = readers.lenient_moments(readers.hydrated(rows))
    return out.select("ride_id", "seq", "id", F.array_join("sources", ",").alias("sources"), "status", "rating", "notes")


@query("""
  r AS (SELECT o_custkey AS date_folder, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'p' WHEN 1 THEN NULL ELSE 'q' END AS provider, CASE WHEN o_orderkey % 2 = 0 THEN 'x_scoped.json' ELSE 'legacy.json' END AS f, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 50 END AS n, o_orderkey % 7 AS old FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY date_folder ORDER BY CASE WHEN f = 'x_scoped.json' THEN 0 ELSE 1 END, f, o_orderkey) AS rn FROM r WHERE coalesce(provider, 'p') = 'p')
  SELECT date_folder, coalesce(n, old)::INT AS n_model_hits FROM k WHERE rn = 1""")
def src15_preferred_reports(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 2 == 0, "x_scoped.json").otherwise("legacy.json")
    best = table(spark, d, "orders").select(F.col("o_custkey").alias("date_folder"), k, F.when(k % 3 == 0, "p").when(k % 3 == 2, "q").alias("provider"), F.lit(None).cast("string").alias("model"), F.concat(name, F.format_string("#%012d", k)).alias("file"), F.when(k % 5 != 0, (k % 50).cast("int")).alias("n_model_hits"), (k % 7).cast("int").alias("n_gemini_hits"), F.lit(0).alias("n_model_only"), F.lit(0).alias("n_gemini_only"), name.alias("bare"))
    kept = readers.preferred_reports(best.withColumn("file", F.concat(F.regexp_extract("file", "#(.*)$", 1), F.lit("/"), "bare")), "p", "m", "x_scoped.json")
    return kept.select("date_folder", "n_model_hits")


@query("""
  SELECT n_nationkey AS way_id, n_name AS name, count(*) AS n_vertices FROM nation, (SELECT unnest(range(0, 3))) GROUP BY ALL""")
def src17_osm_ways(spark, d):
    p = lambda i: F.struct((F.col("n_nationkey") + i).cast("double").alias("lat"), F.lit(float(i)).alias("lon"))
    element = F.struct(F.lit("way").alias("type"), F.col("n_nationkey").cast("long").alias("id"), F.create_map(F.lit("name"), F.col("n_name")).alias("tags"), F.array(p(0), p(1), p(2)).alias("geometry"))
    short = F.struct(F.lit("way").alias("type"), F.lit(-1).cast("long").alias("id"), F.create_map(F.lit("name"), F.lit("one point")).alias("tags"), F.array(p(0)).alias("geometry"))
    osm = table(spark, d, "nation").select(F.array(element, short).alias("elements"))
    return readers.osm_ways(osm).groupBy(F.col("way_id").cast("int").alias("way_id"), "name").agg(F.count(F.lit(1)).alias("n_vertices"))


@query("""
  c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Ward ' || c_custkey ELSE c_name END AS q, c_mktsegment AS town, c_name || ', far' AS disp FROM customer)
  SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN upper(q) WHEN c_custkey % 3 = 0 THEN upper(town) ELSE upper(split_part(disp, ',', 1)) END AS locality, CASE WHEN c_custkey % 5 = 0 THEN 'own' WHEN c_custkey % 5 = 1 THEN 'HOME' ELSE town END AS lockup FROM c""")
def fn18_fn26_locality_and_lockup(spark, d):
    c = F.col("c_custkey")
    keys = {k: F.lit(None).cast("string") for k in s.LOCALITY_KEYS} | {"quarter": F.when(c % 2 == 0, F.concat(F.lit("Ward "), c)).otherwise(F.col("c_name")), "town": F.when(c % 3 == 0, F.col("c_mktsegment"))}
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.struct(*[v.alias(k) for k, v in keys.items()]).alias("a"), F.concat("c_name", F.lit(", far")).alias("disp"))
    lockup = s.lockup(F.when(c % 5 == 0, "own"), F.when(c % 5 == 1, "UNKNOWN").otherwise(F.col("c_mktsegment")), "HOME")
    return rows.select("c_custkey", s.locality(F.col("a"), F.col("disp")).alias("locality"), lockup.alias("lockup"))


@query("""
  SELECT ride_id, seq, CASE WHEN seq % 4 = 0 THEN 1.5 ELSE value END AS anchor, CASE WHEN seq % 3 = 0 THEN 2.0 ELSE value - 1 END AS start_, CASE WHEN seq % 3 = 0 THEN 9.0 ELSE value + 1 END AS end_, event_type IN ('click', 'view') AS included FROM points""")
def fn25_effective_moments(spark, d):
    k = F.col("seq")
    status = F.when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "view", "auto").when(F.col("event_type") == "error", "rejected")
    a, b, e, inc = s.effective(F.col("value"), F.when(k % 4 == 0, 1.5), F.col("value") - 1, F.col("value") + 1, F.when(k % 3 == 0, F.array(F.lit(2.0), F.lit(9.0))), status)
    return points(spark, d).select("ride_id", "seq", a.alias("anchor"), b.alias("start_"), e.alias("end_"), inc.alias("included"))


@query("""
  SELECT ride_id, seq, event_type FROM points WHERE event_type IN ('view', 'click') OR event_type = 'error'""")
def fn32_chapter_filter(spark, d):
    p = points(spark, d).withColumn("clip_name", F.when(F.col("event_type") != "error", F.col("event_type")))
    known = spark.createDataFrame([("view",), ("click",), ("",)], "clip_name string")
    return joins.in_chapters(p, known, keep_unnamed=True).select("ride_id", "seq", "event_type")


@query("""
  f AS (SELECT c_nationkey::VARCHAR AS ride_folder, c_custkey, 'GX' || lpad(c_custkey::VARCHAR, 6, '0') AS base, c_custkey % 2 = 0 AS has_proxy FROM customer)
  SELECT c_custkey, CASE WHEN has_proxy THEN 'GL' || base[3:] || '.LRV' ELSE base || '.MP4' END AS proxy_name FROM f""")
def j18_proxies(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("ride_folder"), "c_custkey", F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("n"))
    full = c.select("ride_folder", F.concat(F.lit("/r/GX"), "n", F.lit(".MP4")).alias("path"))
    small = c.where("c_custkey % 2 = 0").select("ride_folder", F.concat(F.lit("/r/GL"), "n", F.lit(".LRV")).alias("path"))
    out = readers.proxies(full.unionByName(small))
    return out.select(F.regexp_extract("path", r"GX(\d+)", 1).cast("long").alias("c_custkey"), F.regexp_extract("proxy_path", r"[^/]*$", 0).alias("proxy_name"))


@query("""
  r AS (SELECT ride_id, seq, seq % 8 AS shape, (seq % 7)::INT AS v, (seq * 3 % 6)::INT AS a, seq % 5 = 0 AS twice FROM points),
  t AS (SELECT *, shape IN (0, 1, 2, 3) AND v BETWEEN 1 AND 5 AND a BETWEEN 1 AND 5 AS ok FROM r)
  SELECT ride_id, seq, CASE WHEN ok THEN CASE WHEN twice THEN 2 ELSE 1 END END AS n_frames, CASE WHEN ok THEN v END AS visual, CASE WHEN ok THEN CASE WHEN shape = 3 THEN 50 ELSE 7 END END AS crop_x,
    CASE WHEN ok THEN NULL WHEN shape < 4 THEN 'invalid frames' WHEN shape = 4 THEN 'no frames in object' WHEN shape = 5 THEN 'no frames in bigint' ELSE 'no JSON' END AS error FROM t""")
def bi5_frames_in_replies(spark, d):
    """Replies of eight shapes: arrays, objects that hold one, fenced, with trailing commas, without frames, broken, empty."""
    k = F.col("seq")
    frame = F.format_string('{"frame_index": %d, "visual": %d, "action": %d%s}', k % 60, k % 7, k * 3 % 6, F.when(k % 8 == 3, "").otherwise(', "crop_x": 7'))
    frames = F.concat(F.lit("["), frame, F.when(k % 5 == 0, F.concat(F.lit(", "), frame)).otherwise(""), F.lit("]"))
    shapes = [frames, F.concat(F.lit('{"frames": '), frames, F.lit("}")), F.concat(F.lit("```json\n"), frames, F.lit("\n```")), F.regexp_replace(frames, "]$", ",]"), F.lit('{"items": []}'), F.lit("42"), F.lit("no reply ["), F.lit("")]
    text = reduce(lambda a, i: F.when(k % 8 == i, shapes[i]).otherwise(a), range(8), F.lit(""))
    rows = points(spark, d).select("ride_id", "seq", scoring.frames_in(text).alias("r"))
    first = F.get("r.value", F.lit(0))
    return rows.select("ride_id", "seq", F.when(F.col("r.value").isNotNull(), F.size("r.value")).alias("n_frames"), first["visual"].alias("visual"), first["crop_x"].alias("crop_x"), F.col("r.error").alias("error"))


@query("SELECT ride_id, seq, (seq % 60 < 50 AND seq % 7 BETWEEN 1 AND 5 AND seq % 6 BETWEEN 1 AND 5) AS valid FROM points")
def bi5_valid_scores(spark, d):
    k = F.col("seq")
    rows = points(spark, d).select("ride_id", "seq", (k % 60).alias("frame_index"), (k % 7).alias("visual"), (k % 6).alias("action"), F.lit(None).cast("int").alias("crop_x"))
    return rows.select("ride_id", "seq", scoring.valid_frame().alias("valid"))


@query("SELECT ride_id, seq, batch_id FROM (SELECT ride_id, seq, ((row_number() OVER (PARTITION BY ride_id ORDER BY ts, seq) - 1) // 50)::INT AS batch_id FROM points)")
def bi1_batches(spark, d):
    return joins.batches(points(spark, d), 50, ["ride_id"], ["ts", "seq"]).select("ride_id", "seq", "batch_id")
