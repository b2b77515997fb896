"""As-of, interval and matching joins on an entity key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import epoch_seconds, num, seconds_between
from .folds import Matcher, dealt_in_runs

#: Most instants of a clip that are told from one row.
STRETCH = 65_536


def asof_nearest(probes: DataFrame, points: DataFrame, payload: list[str], key: str = "ride_id", probe_ts: str = "probe_ts", ts: str = "ts", seq: str = "seq", later_wins: bool = False, tolerance_secs: float | None = None) -> DataFrame:
    """`probes` with the payload of the closest point, and `asof_ts` and `asof_gap`; null where there is none.

    Ties of distance go to the earlier point (or the later one), points of one instant to the first. A probe without a time has the
    first point, and points without one count only where no other is. A point is nearest from the middle of the gap before it on:
    points are sorted to know their middles, then both sides are united and sorted once by these, and a running last value
    replaces a range join, so the cost is linear however many points an entity has.
    """
    micros = lambda c: F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c)
    by_time = Window.partitionBy("k").orderBy("us", "s")
    right = points.select(F.col(key).alias("k"), micros(F.col(ts)).alias("us"), F.col(seq).cast("long").alias("s"), F.struct(F.col(ts).alias("asof_ts"), *payload).alias("p"))
    right = right.withColumn("rn", F.row_number().over(by_time)).withColumn("before", F.lag("us").over(by_time)).where("rn = 1 or not before <=> us")
    # Twice the middles, to stay whole. Least are points without a time, then an entity's first one, then probes without one.
    least = -(2**63)
    middle = F.when(F.col("us").isNull(), F.lit(least)).otherwise(F.coalesce(F.col("before") + F.col("us"), F.lit(least + 1)))
    right = right.select("k", middle.alias("x"), F.lit(1).alias("side"), "p")
    left = probes.select(F.col(key).alias("k"), F.coalesce(2 * micros(F.col(probe_ts)), F.lit(least + 2)).alias("x"), F.lit(2 if later_wins else 0).alias("side"), F.struct(*probes.columns).alias("probe"))
    both = left.unionByName(right, allowMissingColumns=True)
    upto = Window.partitionBy("k").orderBy("x", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("found", F.last("p", ignorenulls=True).over(upto)).where("side <> 1").select("probe", "found")
    rows = rows.withColumn("gap", F.abs(seconds_between(F.col("found.asof_ts"), F.col(f"probe.{probe_ts}"))))
    if tolerance_secs is not None:
        rows = rows.withColumn("found", F.when(F.col("gap") <= tolerance_secs, F.col("found"))).withColumn("gap", F.when(F.col("found").isNotNull(), F.col("gap")))
    return rows.select("probe.*", "found.*", F.col("gap").alias("asof_gap"))


def within(probes: DataFrame, points: DataFrame, half_secs: float, key: str = "ride_id", probe_ts: str = "probe_ts", ts: str = "ts") -> DataFrame:
    """Pairs with |point - probe| at most half_secs: an equi-join on (key, bucket), each probe in the buckets it reaches."""
    width = max(2 * half_secs, 1e-6)
    bucket = lambda t: F.floor(t / width)
    t = epoch_seconds(F.col(probe_ts))
    left = probes.withColumn("bucket", F.explode(F.sequence(bucket(t - half_secs), bucket(t + half_secs))))
    right = points.withColumn("bucket", bucket(epoch_seconds(F.col(ts))))
    joined = left.join(right, [key, "bucket"])
    return joined.where(F.abs(seconds_between(F.col(probe_ts), F.col(ts))) <= half_secs).drop("bucket")


def in_range(ranges: DataFrame, points: DataFrame, key: str = "ride_id", start: str = "start_ts", end: str = "end_ts", ts: str = "ts", bucket_secs: float = 3600.0) -> DataFrame:
    """Pairs of a range and a point with start <= ts <= end, by (key, time bucket)."""
    bucket = lambda c: F.floor(epoch_seconds(F.col(c)) / bucket_secs)
    left = ranges.where(F.col(start) <= F.col(end)).withColumn("bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    right = points.withColumn("bucket", bucket(ts))
    return left.join(right, [key, "bucket"]).where(F.col(ts).between(F.col(start), F.col(end))).drop("bucket")


def first_containing(probes: DataFrame, clips: DataFrame, key: str = "ride_id", at: str = "at_secs", start: str = "clip_start", end: str = "clip_end", clip: str = "clip_name", how: str = "inner") -> DataFrame:
    """`probes` with the first clip, by start and name, that contains the instant (inclusive), and `video_secs`. Every probe keeps
    a row of its own (`how` inner: those on a clip); clips without a name don't count.

    In order of start and name, a clip is the first of some instants only if it ends after all clips before it, and of those alone
    that lie after these. So such clips end in order, an instant's clip can only be the next of them to end, and one sort of both
    sides finds it: the cost is linear however long clips are and however many overlap.
    """
    spans = clips.where((F.col(start) <= F.col(end)) & F.col(key).isNotNull() & F.col(clip).isNotNull()).select(F.col(key).alias("k"), F.col(end).alias("x"), F.struct(F.col(start).alias("c_start"), F.col(clip).alias("c_name")).alias("c"))
    ended = F.max("x").over(Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("ended", ended).where("ended is null or x > ended")
    left = probes.select(F.col(key).alias("k"), F.col(at).alias("x"), F.lit(1).alias("side"), F.struct(*[F.col(f"`{c}`") for c in probes.columns]).alias("probe"))
    right = spans.select("k", "x", F.lit(0).alias("side"), "c")
    both = left.unionByName(right, allowMissingColumns=True)
    ahead = Window.partitionBy("k").orderBy(F.desc("x"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("c", F.last("c", ignorenulls=True).over(ahead)).where("side = 1")
    rows = rows.withColumn("c", F.when(F.col("c.c_start") <= F.col("x"), F.col("c")))
    found = rows if how == "left" else rows.where("c is not null")
    return found.select("probe.*", F.col("c.c_name").alias(clip), (F.col("x") - F.col("c.c_start")).alias("video_secs"))


def overlapping_clips(clips: DataFrame, key: str = "ride_id", start: str = "clip_start", duration: str = "duration_secs", total: str = "ride_secs") -> DataFrame:
    """Clips that overlap 0..total, with the clamped span."""
    end = F.col(start) + F.col(duration)
    kept = clips.where((end >= 0) & (F.col(start) <= F.col(total)))
    return kept.withColumn("span_start", F.greatest(num(0), F.col(start))).withColumn("span_end", F.least(F.col(total), end))


def clip_offsets(clips: DataFrame, offsets: DataFrame, manual: Column | None = None, detected: Column | None = None, key: str = "ride_id", clip: str = "clip_name", tolerance: float = 5.0) -> DataFrame:
    """`clips` with `offset_secs`: manual if not 0, else the clip's own unless it is an outlier, else the ride's median
    of its offsets, else the detected one, else 0."""
    middle = offsets.groupBy(key).agg(F.median("offset").alias("mid"))
    own = offsets.join(middle, key).where(F.abs(F.col("offset") - F.col("mid")) <= tolerance).select(key, clip, F.col("offset").alias("own"))
    none = F.lit(None).cast("double")
    chosen = F.coalesce(F.when((none if manual is None else manual) != 0, manual if manual is not None else none), F.col("own"), F.col("mid"), none if detected is None else detected, num(0))
    return clips.join(own, [key, clip], "left").join(middle, key, "left").withColumn("offset_secs", chosen).drop("own", "mid")


def ride_second(wall: Column, ride_start: Column, offset: Column) -> Column:
    """Second of the ride at a wall time."""
    return seconds_between(ride_start, wall) + F.coalesce(offset, num(0))


def greedy_match(labels: DataFrame, hits: DataFrame, window: float, key: str = "ride_id", t: str = "t", label_id: str = "label_id", hit_id: str = "hit_id") -> DataFrame:
    """(key, label_id, hit_id, outcome): labels in time order each take the closest unclaimed hit within the window,
    the earlier on ties; the rest are label_only or model_only. A fold over streams of runs that no match crosses, since a gap
    in them is wider than the window. Rows without a time match nothing."""
    side = lambda df, c, is_label: df.select(F.col(key).alias("k"), F.col(t).cast("double").alias("t"), F.col(c).cast("long").alias("id"), F.lit(is_label).alias("is_label"))
    rows = side(labels, label_id, True).unionByName(side(hits, hit_id, False))
    rows = dealt_in_runs(rows, "k", "t", F.col("t") - F.col("before") > window, ["t", "is_label", "id"])
    kind = rows.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run, matcher, out, key_type = None, Matcher(window), [], pa.null()

        def told() -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), types, strict=True)], names=["k", "label_id", "hit_id", "outcome"])

        for batch in batches:
            key_type = batch.column("k").type
            for k, number, at, row_id, is_label in zip(*(batch.column(c).to_pylist() for c in ("k", "run", "t", "id", "is_label")), strict=True):
                if (k, number) != open_run:
                    out += [(open_run[0], *x) for x in matcher.end()] if open_run else []
                    open_run = (k, number)
                out += [(k, *x) for x in matcher.add(at, row_id, is_label)]
            if out:
                yield told()
                out = []
        if open_run:
            out = [(open_run[0], *x) for x in matcher.end()]
            if out:
                yield told()

    schema = T.StructType([T.StructField("k", kind), T.StructField("label_id", T.LongType()), T.StructField("hit_id", T.LongType()), T.StructField("outcome", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def clip_feed(clips: DataFrame, points: DataFrame, base: DataFrame, payload: list[str], step: float = 1.0, key: str = "ride_id", clip: str = "clip_name", start: str = "clip_start", duration: str = "duration_secs", ts: str = "ts", seq: str = "seq", bucket_secs: float = 3600.0) -> DataFrame:
    """(key, clip, video_sec, payload): the point nearest to every `step` seconds of each clip, from its start (in seconds of the
    ride, from `base`'s t0) on; ties of distance go to the earlier point, of points of one instant to the first.

    A point is nearest to the instants between the middles of its gaps. Of a clip's points one has its start, found by one sort of
    both sides, and the others' spans start within the clip: an equi-join on (key, time bucket), in which a point stands once,
    however long its gaps, and a clip in the buckets that it reaches. The seconds of both are told last: neither the grid nor
    anything per second is shuffled or sorted. Few bytes make very many seconds, so they are dealt in stretches to a fixed number of
    partitions. All times are whole microseconds.
    """
    micros = lambda secs: F.round(secs * 1e6).cast("long")
    width, tick = int(max(bucket_secs, step) * 1e6), int(round(step * 1e6))
    spans = clips.where(F.col(duration) >= 0).select(F.col(key).alias("k"), F.col(clip).alias("c_name"), micros(F.col(start)).alias("c_from"), F.floor(F.col(duration) / step).alias("c_last")).where("c_from is not null")
    at = F.expr(f"unix_micros(cast({ts} as timestamp)) - unix_micros(cast(t0 as timestamp))")
    timed = points.join(base.select(key, "t0"), key).select(F.col(key).alias("k"), at.alias("p_at"), F.col(seq).alias("p_seq"), F.struct(*payload).alias("p")).where("p_at is not null")
    by_time = Window.partitionBy("k").orderBy("p_at", "p_seq")
    first = timed.withColumn("before", F.lag("p_at").over(by_time)).where("before is null or before < p_at")  # one of each instant
    around = Window.partitionBy("k").orderBy("p_at")
    # Twice the middles, to stay whole: a point is nearest to x where low < 2x <= high; null has no bound.
    owned = first.select("k", "p", (F.col("before") + F.col("p_at")).alias("low"), (F.col("p_at") + F.lead("p_at").over(around)).alias("high"))
    lows = owned.select("k", F.coalesce("low", F.lit(-(2**63))).alias("x"), F.lit(1).alias("side"), F.struct("p", "low", "high").alias("o"))
    both = lows.unionByName(spans.select("k", (2 * F.col("c_from")).alias("x"), F.lit(0).alias("side"), F.struct("c_name", "c_from", "c_last").alias("c")), allowMissingColumns=True)
    upto = Window.partitionBy("k").orderBy("x", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = both.withColumn("o", F.last("o", ignorenulls=True).over(upto)).where("side = 0 and o is not null").select("k", "o.*", "c.*")
    bucket = lambda x: F.floor(x / width)
    c_to = F.col("c_from") + F.col("c_last") * tick
    reached = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("c_from")), bucket(c_to))))
    later = owned.where("low is not null").withColumn("bucket", bucket(F.col("low") / 2)).join(reached, ["k", "bucket"]).where((F.col("low") >= 2 * F.col("c_from")) & (F.col("low") < 2 * c_to))
    pairs = starts.unionByName(later.drop("bucket"))
    from_k = F.greatest(F.lit(0), F.coalesce(F.floor((F.col("low") - 2 * F.col("c_from")) / (2 * tick)) + 1, F.lit(0)))
    to_k = F.least(F.col("c_last"), F.coalesce(F.floor((F.col("high") - 2 * F.col("c_from")) / (2 * tick)), F.col("c_last")))
    whole = pairs.select("k", "c_name", "p", from_k.alias("from_k"), to_k.alias("to_k")).where("from_k <= to_k")
    stretches = whole.withColumn("from_k", F.explode(F.sequence("from_k", "to_k", F.lit(STRETCH)))).withColumn("to_k", F.least("to_k", F.col("from_k") + (STRETCH - 1)))
    dealt = stretches.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "c_name", "from_k")
    return dealt.select(F.col("k").alias(key), F.col("c_name").alias(clip), F.explode(F.sequence("from_k", "to_k")).alias("sec"), "p.*").withColumn("video_sec", F.col("sec") * num(step)).drop("sec")


def nearest_vertex(probes: DataFrame, vertices: DataFrame, key: str = "ride_id", idx: str = "idx") -> DataFrame:
    """(key, vertex_idx): the route vertex nearest an end pin (pin_lat, pin_lon) in squared degrees, the first on ties;
    without a pin, the one farthest from the start."""
    first = vertices.groupBy(key).agg(F.min_by(F.struct("lat", "lon"), idx).alias("start"))
    rows = vertices.join(first, key).join(probes.select(key, "pin_lat", "pin_lon"), key, "left")
    square = lambda a, b: F.pow(F.col("lat") - a, 2) + F.pow(F.col("lon") - b, 2)
    d = F.when(F.col("pin_lat").isNotNull(), square(F.col("pin_lat"), F.col("pin_lon"))).otherwise(-square(F.col("start.lat"), F.col("start.lon")))
    return rows.groupBy(key).agg(F.min_by(idx, F.struct(d, idx)).alias("vertex_idx"))


def by_position(selections: DataFrame, candidates: DataFrame, key: str = "ride_id", order: tuple[str, ...] = ("seq",), old: str = "sel_key", stable: str = "stable_id") -> DataFrame:
    """Selections keyed by position moved to stable ids; keys that are ids stay, dangling positions are dropped."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = candidates.select(key, stable, (F.row_number().over(w) - 1).cast("string").alias("position"))
    numbered = selections.where(F.col(old).rlike(r"^\d+$")).join(placed, [selections[key] == placed[key], selections[old] == placed["position"]]).select(selections["*"], placed[stable])
    return numbered.unionByName(selections.where(~F.col(old).rlike(r"^\d+$")).withColumn(stable, F.col(old)))


def not_cached(requests: DataFrame, cache: DataFrame, cache_key: str = "cache_key") -> DataFrame:
    """Requests whose key the cache lacks."""
    return requests.join(cache.select(cache_key).distinct(), cache_key, "left_anti")


def marked_selected(candidates: DataFrame, selected: DataFrame, on: list[str]) -> DataFrame:
    """`candidates` with boolean `selected`, by equal stable ids."""
    picks = selected.select(*on).distinct().withColumn("selected", F.lit(True))
    return candidates.join(picks, on, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def in_chapters(rows: DataFrame, chapters: DataFrame, clip: str = "clip_name", keep_unnamed: bool = False) -> DataFrame:
    """Rows of known chapters; with `keep_unnamed` also rows without a clip. No known chapter means no filter."""
    known = chapters.select(F.col(clip).alias("known")).where(F.coalesce("known", F.lit("")) != "").distinct()
    if not known.take(1):
        return rows
    joined = rows.join(known, F.col(clip) == F.col("known"), "left")
    unnamed = (F.coalesce(F.col(clip), F.lit("")) == "") if keep_unnamed else F.lit(False)
    return joined.where(F.col("known").isNotNull() | unnamed).drop("known")


def batches(rows: DataFrame, size: int, key: list[str], order: list[str]) -> DataFrame:
    """`rows` with `batch_id`: runs of `size` rows within a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("batch_id", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


