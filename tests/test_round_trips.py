"""Replies, reports, inventories and edits: what is written is read back, and broken input is told."""

import datetime as dt
import json
import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trailmark.operators import aggregates, geo, joins, ranker, scoring
from trailmark.plans.queries import ORACLE_SQL, QUERIES
from trailmark.sources import readers, sinks

from .helpers import assert_same, duck


def unwrapped(spark, how, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = {r["i"]: (r["r"]["value"], r["r"]["error"]) for r in df.select("i", how(F.col("text")).alias("r")).collect()}
    return [out[i] for i in range(len(texts))]


FRAME = {"frame_index": 3, "visual": 5, "action": 1}


@pytest.mark.parametrize(
    ("text", "n", "error"),
    [
        (json.dumps([FRAME]), 1, None),
        (json.dumps({"frames": [FRAME, FRAME | {"crop_x": 0, "reason": "r", "clip_type": "t"}]}), 2, None),
        ("```json\n" + json.dumps([FRAME]) + "\n```", 1, None),
        ("Here: " + json.dumps([FRAME])[:-1] + ", ] ok", None, "no frames in object"),
        (json.dumps([FRAME])[:-1] + ",]", 1, None),
        ("[]", 0, None),
        ('{"frames": []}', 0, None),
        ('{"frames": {"a": 1}}', None, "no frames in object"),
        ("{}", None, "no frames in object"),
        ("7", None, "no frames in bigint"),
        ("not json", None, "no JSON"),
        ("", None, "no JSON"),
        (None, None, "no JSON"),
        (json.dumps([FRAME, FRAME | {"visual": 6}]), None, "invalid frames"),
        (json.dumps([FRAME | {"action": 2.5}]), None, "invalid frames"),
        (json.dumps([FRAME | {"crop_x": 101}]), None, "invalid frames"),
        (json.dumps([{"visual": 3, "action": 3}]), None, "invalid frames"),
        (json.dumps([[1]]), None, "invalid frames"),
    ],
)
def test_frames_in_replies(spark, text, n, error):
    [(value, got)] = unwrapped(spark, scoring.frames_in, [text])
    assert got == error and (value is None if n is None else len(value) == n)
    if n:
        assert value[0].asDict() == {"frame_index": 3, "visual": 5, "action": 1, "clip_type": "", "crop_x": 50, "reason": ""}


def test_indices_and_rubrics_in_replies(spark):
    assert unwrapped(spark, scoring.indices_in, ["[3, 1]", '{"indices": [2]}', '["a"]', "[1.5]", "[true]", '{"x": [1]}', None]) == [
        ([3, 1], None), ([2], None), (None, "invalid indices"), (None, "invalid indices"), (None, "invalid indices"), (None, "no indices in object"), (None, "no JSON")
    ]
    rubric = {"light": 1, "composition": 10, "motion": 3, "scenery": 4, "subject": 5}
    got = unwrapped(spark, scoring.rubric_in, [json.dumps(x) for x in (rubric, [rubric | {"peak_offset": 0.25, "crop_x": 7}], [], [1], rubric | {"light": 0}, rubric | {"peak_offset": 1.5}, {"light": 1})])
    assert [e for _, e in got] == [None, None, "no rubric in array", "no rubric in array", "invalid rubric", "invalid rubric", "invalid rubric"]
    assert got[0][0].asDict() == rubric | {"peak_offset": 0.5, "clip_type": "", "crop_x": 50, "reason": ""}
    assert (got[1][0]["peak_offset"], got[1][0]["crop_x"]) == (0.25, 7)


def inside_by_hand(lat, lon, ring):
    n, found = len(ring), False
    for i in range(n):
        (a, b), (c, d) = ring[i], ring[i - 1]
        if (a > lat) != (c > lat) and lon < (d - b) * (lat - a) / (c - a) + b:
            found = not found
    return found


def test_points_in_ragged_polygons(spark):
    rng = random.Random(10)
    rings = {}
    for k in range(6):
        n = rng.choice([3, 5, 40, 300])
        rings[k] = [(40 + k * 0.01 + rng.random() * 0.3, -74 + rng.random() * 0.3) for _ in range(n)]  # any ring, crossing itself too
    rings[9] = [(40.0, -74.0), (40.0, -73.9), (40.0, -73.8)]  # flat
    points = [(1, i, 40 + rng.random() * 0.36, -74 + rng.random() * 0.3) for i in range(400)] + [(1, 1000 + i, lat, lon) for i, (lat, lon) in enumerate(rings[0])]
    want = {(seq, k) for _, seq, lat, lon in points for k, ring in rings.items() if inside_by_hand(lat, lon, ring)}
    vertices = spark.createDataFrame([(k, i, lat, lon) for k, ring in rings.items() for i, (lat, lon) in enumerate(ring)], "poly_id long, idx int, lat double, lon double")
    got = geo.points_in_polygons(spark.createDataFrame(points, "ride_id long, seq long, lat double, lon double"), vertices).collect()
    assert {(r["seq"], r["poly_id"]) for r in got} == want and len(got) == len(want)


def test_of_parks_with_as_many_points_the_first_counts(spark):
    points = spark.createDataFrame([(1, i, 1.0, 1.0) for i in range(4)], "ride_id long, seq long, lat double, lon double")
    inside = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (1, 2, 3), (1, 3, 9)], "ride_id long, seq long, poly_id long")
    names = spark.createDataFrame([(7, "zoo"), (3, "alm"), (9, "alm")], "poly_id long, name string")
    assert tuple(geo.park_share(points, inside, names).first()) == (1, "alm", 0.5)


def test_copies_of_a_polygon_are_one_shape(spark):
    """Each copy was asked for by every point: as many rows as points times polygons."""
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    rows = [(k, i, lat + (5.0 if k == 9 else 0.0), lon) for k in (3, 4, 7, 9) for i, (lat, lon) in enumerate(ring)]
    outlines, members = geo.shapes(spark.createDataFrame(rows, "poly_id long, idx int, lat double, lon double"))
    assert sorted({r["shape_id"] for r in outlines.collect()}) == [3, 9]
    assert sorted(map(tuple, members.collect())) == [(3, 3), (4, 3), (7, 3), (9, 9)]
    points = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, 5.5, 0.5), (1, 2, 5.5, 0.6), (2, 3, 9.0, 0.5)], "ride_id long, seq long, lat double, lon double")
    inside = geo.points_in_shapes(points, outlines, poly="shape_id")
    assert sorted(map(tuple, inside.collect())) == [(1, 0, 3), (1, 1, 9), (1, 2, 9)]
    names = spark.createDataFrame([(3, "zoo"), (4, "alm"), (7, "alm"), (9, "see")], "poly_id long, name string")
    # "alm" and "see" hold two each, and the first polygon of "alm" comes first.
    assert sorted(map(tuple, geo.park_share(points, inside, names, members).collect())) == [(1, "alm", 2 / 3), (2, "", 0.0)]


def test_of_places_at_one_spot_one_is_asked(spark):
    places = spark.createDataFrame([(40.0, -74.0, 2, "b"), (40.0, -74.0, 1, "z"), (40.0, -74.0, 1, "c"), (40.01, -74.0, 1, "a"), (40.0, -74.0, 1, "ward 3")], "lat double, lon double, rank int, name string")
    pins = spark.createDataFrame([(1, 40.0, -74.0), (2, 40.009, -74.0), (3, 50.0, 0.0)], "ride_id long, pin_lat double, pin_lon double")
    assert sorted(map(tuple, geo.best_place(pins, places).collect())) == [(1, "c"), (2, "a")]


def test_every_second_has_its_nearest_point(spark):
    rng = random.Random(17)
    start = 1_700_000_000
    points = [(ride, i, start + t / 1000, i * 10) for ride in (1, 2) for i, t in enumerate(sorted(rng.choice([rng.randrange(60_000), rng.randrange(60) * 1000]) for _ in range(40)))]
    points += [(1, 100 + i, points[5][2], -1) for i in range(2)]  # of one instant
    clips = [(1, "a", 0.0, 20.0), (1, "b", 10.5, 30.25), (2, "c", -7.5, 90.0), (2, "d", 59.0, 0.5), (2, "e", 5.0, -1.0), (3, "f", 0.0, 5.0)]
    df = spark.createDataFrame(points, "ride_id long, seq long, secs double, v int").withColumn("ts", F.timestamp_micros(F.round(F.col("secs") * 1e6).cast("long")).cast("timestamp_ntz"))
    base = df.groupBy("ride_id").agg(F.min("ts").alias("t0"))
    feed = joins.clip_feed(spark.createDataFrame(clips, "ride_id long, clip_name string, clip_start double, duration_secs double"), df, base, ["seq", "v"], step=0.5, bucket_secs=7.0)
    want = set()
    for ride, name, at, secs in clips:
        own = [(round(t * 1e6), seq, v) for r, seq, t, v in points if r == ride]
        for k in range(int(secs // 0.5) + 1 if own and secs >= 0 else 0):
            x = min(o[0] for o in own) + round(at * 1e6) + k * 500_000
            near = min(own, key=lambda o: (abs(o[0] - x), o[0], o[1]))
            want.add((ride, name, near[1], near[2], k * 0.5))
    got = feed.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_telemetry_blocks(spark):
    frames = spark.createDataFrame([(1, "b", float(i)) for i in (0, 5, 10)] + [(2, "b", 0.0), (3, "b", 1.0)], "ride_id long, batch string, frame double")
    found = spark.createDataFrame([(1, "b", 0.0, 10.0, 200, 150, 2.6), (1, "b", 10.0, 5.0, None, None, -0.2), (2, "b", 0.0, 4.0, None, 99, None)], "ride_id long, batch string, frame double, speed double, power int, heart_rate int, grade double")
    powered = spark.createDataFrame([(1, True), (2, False), (3, True)], "ride_id long, has_power boolean")
    got = {r["ride_id"]: r["block"] for r in aggregates.telemetry_block(frames, found, powered, ["ride_id", "batch"]).collect()}
    assert got == {
        1: "Baseline: avg 17mph 100W\nFrame 0: 22mph 200W 150bpm +3%\nFrame 1: no data\nFrame 2: 11mph 0W 0bpm -0%",
        2: "Baseline: avg 9mph\nFrame 0: 9mph 99bpm +0%",
        3: "Frame 0: no data",
    }


def test_inventory_feeds_retention(spark, tmp_path):
    for name in ("rides/2024-05-01/GX01.MP4", "rides/2024-05-01/frames/2023-01-01/1.jpg", "rides/2024-05-01/_work/a/b.mp4", "rides/2024-05-01/highlights/a.mp4", "rides/2024-05-01/ride.fit", "rides/old/2024-05-02/GL01.lrv", "rides/misc/x.MP4", "rides/top.MP4"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    files = readers.file_inventory(spark, str(tmp_path / "rides"))
    assert {(r["ride_folder"], r["ride_path"]) for r in files.collect()} == {
        ("2024-05-01", "GX01.MP4"), ("2024-05-01", "frames/2023-01-01/1.jpg"), ("2024-05-01", "_work/a/b.mp4"), ("2024-05-01", "highlights/a.mp4"), ("2024-05-01", "ride.fit"),
        ("2024-05-02", "GL01.lrv"), ("misc", "x.MP4"), ("", "top.MP4"),
    }
    rows = {r["ride_folder"]: r.asDict() for r in aggregates.retention(files, F.to_date(F.lit("2025-01-01")), path="ride_path").collect()}
    one = rows["2024-05-01"]
    assert (one["raw_files"], one["raw_folders"], one["raw_bytes"], one["has_highlights"], one["skip_reason"]) == (1, 2, 15, True, None)
    assert rows["2024-05-02"]["skip_reason"] == "no highlights" and rows["misc"]["skip_reason"] == "no date"
    inside = readers.file_inventory(spark, str(tmp_path / "rides/2024-05-01/highlights"))
    assert {(r["ride_folder"], r["ride_path"]) for r in inside.collect()} == {("2024-05-01", "highlights/a.mp4")}


def test_selections_are_upserted(spark, tmp_path):
    path = str(tmp_path / "s")
    read = lambda: {(r["ride_id"], r["stable_id"], r["rating"]) for r in spark.read.parquet(path).collect()}
    rows = lambda *x: spark.createDataFrame(list(x), "ride_id string, stable_id string, rating int, at int")
    sinks.save_selections(rows(("r1", "a", 1, 0), ("r1", "b", 2, 0), ("r2", "a", 3, 0)), path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "s/ride_id=r2").iterdir()}
    edits = rows(("r1", "b", 9, 2), ("r1", "b", 8, 1), ("r1", "c", 4, 1))
    for _ in range(2):  # a rerun writes the same
        sinks.save_selections(edits, path, order=["at"])
        assert read() == {("r1", "a", 1), ("r1", "b", 9), ("r1", "c", 4), ("r2", "a", 3)}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "s/ride_id=r2").iterdir()} == before


def test_labels_are_edited_by_position(spark, tmp_path):
    path = str(tmp_path / "l")
    rows = lambda *x: spark.createDataFrame(list(x), "ride_id string, seq int, type string, gone boolean")
    sinks.save_labels(rows(("r", 0, "a", None), ("r", 1, "b", False), ("q", 0, "z", None)), path, gone="gone")
    for _ in range(2):
        sinks.save_labels(rows(("r", 0, "a", True), ("r", 1, "B", False), ("r", 2, "c", None)), path, gone="gone")
    assert {(r["ride_id"], r["seq"], r["type"]) for r in spark.read.parquet(path).collect()} == {("r", 1, "B"), ("r", 2, "c"), ("q", 0, "z")}
    with pytest.raises(ValueError, match="partition"):
        sinks.save_labels(rows(("q", 0, "z", True)), path, gone="gone")


def test_clock_reports_read_back(spark, tmp_path):
    offsets = spark.createDataFrame([("r", "a", 1.5), ("r", "b", -2.0)], "ride_id string, clip_name string, offset double")
    reports = spark.createDataFrame([("r", -0.25, 0.9, "gps", "n", "2024-05-01T00:00:00+00:00"), ("q", 0.0, 0.1, "none", None, None)], "ride_id string, offset_secs double, confidence double, method string, notes string, detected_at string")
    path = str(tmp_path / "s")
    for _ in range(2):
        sinks.save_sync(offsets, reports, path)
    back = readers.saved_sync(spark, path)
    assert {(r["ride_id"], r["offset_secs"], r["method"], tuple(sorted(r["per_chapter"].items()))) for r in back.collect()} == {("r", -0.25, "gps", (("a", 1.5), ("b", -2.0))), ("q", 0.0, "none", ())}
    assert {(r["ride_id"], r["clip_name"], r["offset"]) for r in readers.clip_offset_rows(back).collect()} == {("r", "a", 1.5), ("r", "b", -2.0)}
    sinks.save_sync(offsets.where("clip_name = 'a'"), reports.where("ride_id = 'r'"), path)
    assert {(r["ride_id"], r["clip_name"]) for r in readers.clip_offset_rows(readers.saved_sync(spark, path)).collect()} == {("r", "a")}


def test_top_weights(spark):
    model = {"weights": {"a": 0.5, "b": -2.0, "c": 0.0, "d": 2.0}, "intercept": 1.0}
    assert [tuple(r) for r in ranker.top_weights(spark, model, 3).orderBy("place").collect()] == [("b", -2.0, 1), ("d", 2.0, 2), ("a", 0.5, 3)]


def test_clip_feed_over_long_gaps(spark):
    """Far fewer rows than time buckets: a point months from its neighbours stands in one bucket, and one without a time in none."""
    t = lambda s: None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    month = 30 * 86400.0
    df = spark.createDataFrame([(1, i, t(s)) for i, s in enumerate([0.0, 10 * month, 10 * month + 0.004, None])], "ride_id long, seq long, ts timestamp_ntz")
    base = spark.createDataFrame([(1, t(0.0))], "ride_id long, t0 timestamp_ntz")
    clips = spark.createDataFrame([(1, "a", 0.0, 0.002), (1, "b", 5 * month - 0.001, 0.002), (1, "c", 10 * month, 0.004), (1, "d", None, 1.0)], "ride_id long, clip_name string, clip_start double, duration_secs double")
    feed = joins.clip_feed(clips, df, base, ["seq"], step=0.001, bucket_secs=0.001)
    got = sorted((r["clip_name"], round(r["video_sec"] * 1000), r["seq"]) for r in feed.collect())
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("b", 0, 0), ("b", 1, 0), ("b", 2, 1), ("c", 0, 1), ("c", 1, 1), ("c", 2, 1), ("c", 3, 2), ("c", 4, 2)]


def test_clip_feed_asks_each_second_of_whole_clips(spark, tmp_path):
    """Only one 450th of each clip was asked: 7 seconds of the first and 1 of the second."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    events = [(1, at(0), 1, "view", 1.5), (2, at(1000), 1, "click", 8.0), (3, at(2600), 1, "click", 12.0), (4, at(0), 2, "view", 0.1)]
    columns = [pa.array(c) for c in zip(*events, strict=True)]
    columns[1] = columns[1].cast(pa.timestamp("us"))
    pq.write_table(pa.table([*columns, pa.array(["{}"] * len(events))], names=["event_id", "ts", "user_id", "event_type", "value", "props"]), tmp_path / "events.parquet")
    feed = QUERIES["j17_clip_feed"](spark, str(tmp_path))
    got = sorted((r["clip_name"], r["video_sec"], r["seq"]) for r in feed.collect())
    assert got == [(1, float(k), 1 if k <= 500 else 2 if k <= 1800 else 3) for k in range(2701)] + [(4, float(k), 4) for k in range(181)]
    assert_same(feed, ORACLE_SQL["j17_clip_feed"], duck(str(tmp_path)))


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_seconds_of_a_clip_are_dealt_in_stretches(spark, monkeypatch, stretch):
    """All seconds of a few rows were told by one task."""
    monkeypatch.setattr(joins, "STRETCH", stretch)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(1, i, at(s)) for i, s in enumerate([0, 14, 200])], "ride_id long, seq long, ts timestamp_ntz")
    base = spark.createDataFrame([(1, at(0))], "ride_id long, t0 timestamp_ntz")
    clips = spark.createDataFrame([(1, "a", 0.0, 300.0), (1, "b", 7.0, 6.9), (1, "c", 107.0, 0.0)], "ride_id long, clip_name string, clip_start double, duration_secs double")
    feed = joins.clip_feed(clips, df, base, ["seq"]).withColumn("part", F.spark_partition_id()).collect()
    near = lambda s: 0 if s <= 7 else 1 if s <= 107 else 2
    want = [("a", k, near(k)) for k in range(301)] + [("b", k, near(7 + k)) for k in range(7)] + [("c", 0, 1)]
    assert sorted((r["clip_name"], int(r["video_sec"]), r["seq"]) for r in feed) == want
    assert stretch == 1000 or len({r["part"] for r in feed if r["clip_name"] == "a"}) > 1


def random_tracks(spark, seed, n_ways=60, n_points=300):
    rng = random.Random(seed)
    spot = lambda: (40 + rng.random() * 0.02, -74 + rng.random() * 0.02)
    segments = [(rng.randrange(n_ways), *spot(), *spot()) for _ in range(3 * n_ways)] + [(7, 40.0, -74.0, 40.0, -74.0)]
    points = [(i % 3, i // 3, *((40.0, -74.0) if i < 6 else spot())) for i in range(n_points)] + [(1, 900, None, -74.0), (1, 901, 50.0, -74.0)]
    return spark.createDataFrame(points, "ride_id long, seq long, lat double, lon double"), spark.createDataFrame(segments, "way_id long, a_lat double, a_lon double, b_lat double, b_lon double"), points, segments


@pytest.mark.parametrize("per_row", [1, 7, 1024])
def test_ways_like_a_loop(spark, monkeypatch, per_row):
    """A point meets all segments of its cell, in however many rows of it, and is one row."""
    monkeypatch.setattr(geo, "SEGMENTS", per_row)
    df, segs, points, segments = random_tracks(spark, per_row)
    points = [p for p in points if p[2] is not None]
    flat = lambda lat, lon, c: (lon * geo.METRES_PER_DEGREE * c, lat * geo.METRES_PER_DEGREE)
    want = {}
    for ride, seq, lat, lon in points:
        own = [p[2] for p in points if p[0] == ride]
        c = math.cos(math.radians(sum(own) / len(own)))
        x, y = flat(lat, lon, c)
        best = {}
        for way, *ends in segments:
            (ax, ay), (bx, by) = flat(*ends[:2], c), flat(*ends[2:], c)
            square = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / square)) if square else 0
            best[way] = min(best.get(way, math.inf), math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        near = {w: d for w, d in best.items() if d < 80}
        if near:
            way = min((w for w, d in near.items() if d < 9), default=min(near, key=lambda w: (near[w], w)))
            want[ride, seq] = (way, pytest.approx(near[way], abs=1e-5))
    got = geo.match_ways(df, segs, 80.0, 9.0).collect()
    assert len(got) == len(want) > 50 and {(r["ride_id"], r["seq"]): (r["way_id"], r["dist_m"]) for r in got} == want


def test_ways_are_met_once(spark):
    """Points are no rows for each segment near them, and names and references are counted of one match."""
    df, segs, _, _ = random_tracks(spark, 1)
    matches = geo.match_ways(df, segs, 250.0)
    ways = spark.createDataFrame([(i, f"way {i % 5}" if i % 4 else None, f"R{i % 2}; Q{i % 3};" if i % 3 else None) for i in range(60)], "way_id long, name string, ref string")
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    assert plan(matches).count("collect_list") == 1
    roads = geo.road_attribution(df, matches, ways, 10)
    assert plan(roads).count("avg(lat") == 1
    rows = {(r["ride_id"], r["seq"]): r["way_id"] for r in matches.collect()}
    tags = {r["way_id"]: (r["name"], [x.strip() for x in (r["ref"] or "").split(";") if x.strip()]) for r in ways.collect()}
    for r in roads.collect():
        own = [(seq, tags[w]) for (ride, seq), w in rows.items() if ride == r["ride_id"]]
        count = lambda told: max(((sum(v == x for _, v in told), -min(s for s, v in told if v == x), x) for x in {v for _, v in told}), default=(0, 0, ""))
        n_name, _, name = count([(s, n) for s, (n, _) in own if n is not None])
        n_ref, _, ref = count([(s, v) for s, (_, refs) in own for v in refs])
        by_ref = n_ref >= 10 and n_ref >= n_name
        assert (r["road"], r["n_road"]) == ((ref, n_ref) if by_ref else (name, n_name))


def test_steepest_samples(spark):
    rows = [("a", -3.0), ("a", 2.0), ("a", None), ("b", 1.0), ("b", -1.0), ("c", None), ("d", -2.0), ("e", 0.0), ("e", 5.0), ("e", 1.0)]
    df = spark.createDataFrame(rows, "clip_name string, grade double").withColumn("speed", F.lit(2.0))
    out = aggregates.sample_summary(df, ["speed"])
    assert {r["clip_name"]: (r["n_samples"], r["avg_grade"], r["peak_grade"]) for r in out.collect()} == {"a": (3, -0.5, -3.0), "b": (2, 0.0, 1.0), "c": (1, None, None), "d": (1, -2.0, -2.0), "e": (3, 2.0, 5.0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_samples_meet_starts_unsorted(spark):
    """Where entities are too many to be broadcast, samples aren't sorted to be told their entity's start."""
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(1, i, t(10 * i), 3.0, 100 + i, 90, 10.0 * i, 100.0 * i) for i in range(4)], "ride_id long, seq long, ts timestamp_ntz, speed double, power int, heart_rate int, altitude double, distance double")
    samples = spark.createDataFrame([(1, 0, 0.0), (1, 1, 16.0), (2, 2, 5.0)], "ride_id long, sample_no int, at double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = aggregates.sample_points(samples, df, df.groupBy("ride_id").agg(F.min("ts").alias("t0")))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["sample_no"], r["power"], r["grade"]) for r in out.collect()) == [(0, 100, 0.0), (1, 102, 10.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
