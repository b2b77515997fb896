"""JSON sources with new, old and broken documents; sinks that can be run again."""

import json

from pyspark.sql import functions as F

from trailmark.sources import readers, sinks


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_hits_old_new_and_malformed(spark, tmp_path):
    write(tmp_path / "a_v3_mabc.json", [{"clip_name": "x", "anchor_video_secs": 3.75, "rubric": {"light": 1}}, {"clip_name": "x", "video_secs": 9.0, "visual": 7}, {"clip_name": "x"}])
    write(tmp_path / "b_v3_mabc_l2.json", "{broken")
    write(tmp_path / "c_abc_mzzz.json", [{"clip_name": "z"}])
    rows = readers.json_rows(spark, str(tmp_path), readers.HITS).withColumn("file", F.col("_metadata.file_name"))
    got = readers.cached_hits(rows, "abc").collect()
    assert sorted(r["position"] for r in got) == [0.0, 3.75, 9.0]


def test_sync_and_training(spark, tmp_path):
    write(tmp_path / "s" / "sync.json", {"offset_secs": -14.65, "confidence": 1.0, "per_chapter": {"a": -14.5, "b": -14.8}, "extra": 1})
    sync = readers.json_rows(spark, str(tmp_path / "s"), readers.SYNC).withColumn("ride_id", F.lit("r"))
    assert {(r["clip_name"], r["offset"]) for r in readers.clip_offset_rows(sync).collect()} == {("a", -14.5), ("b", -14.8)}
    write(tmp_path / "t" / "t.jsonl", '{"ride_id": "r", "candidate_idx": 0, "selected": 1, "visual": 3.0}\n')
    row = readers.training_rows(readers.json_rows(spark, str(tmp_path / "t"), readers.TRAINING, multiline=False)).first()
    assert row["visual"] == 3.0 and row["strava_stars"] == 0.0


def test_osm_parks_and_places(spark, tmp_path):
    ring = [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}]
    doc = {"elements": [{"type": "way", "id": 1, "tags": {"name": "Park", "leisure": "park"}, "geometry": ring}, {"type": "way", "id": 2, "tags": {"name": "Open"}, "geometry": ring[:3]}, {"type": "node", "id": 3, "lat": 1.5, "lon": 2.5, "tags": {"name": "Nyack", "place": "village"}}, {"type": "way", "id": 4, "center": {"lat": 5, "lon": 6}, "tags": {"name": "Big", "place": "city"}}, {"type": "node", "id": 5, "lat": 1, "lon": 1, "tags": {"name": "Farm", "place": "farm"}}]}
    write(tmp_path / "osm.json", doc)
    osm = readers.json_rows(spark, str(tmp_path), readers.OSM)
    assert {r["poly_id"] for r in readers.osm_parks(osm).collect()} == {1}
    assert {(r["name"], r["rank"], r["lat"]) for r in readers.osm_places(osm).collect()} == {("Nyack", 2, 1.5), ("Big", 4, 5.0)}


def test_inventory_reads_names_only(spark, tmp_path):
    for name in ("2024-01-05 ride/GX010001.MP4", "2024-01-05 ride/GL010001.LRV", "2024-01-05 ride/GX010002.MP4"):
        write(tmp_path / name, "data")
    files = readers.file_inventory(spark, str(tmp_path))
    assert sorted((r["suffix"], r["length"]) for r in files.collect()) == [(".lrv", 4), (".mp4", 4), (".mp4", 4)]
    pairs = {r["path"].rsplit("/", 1)[1]: r["proxy_path"].rsplit("/", 1)[1] for r in readers.proxies(files).collect()}
    assert pairs == {"GX010001.MP4": "GL010001.LRV", "GX010002.MP4": "GX010002.MP4"}


def test_sinks_overwrite_only_their_rides(spark, tmp_path):
    path = str(tmp_path / "moments")
    make = lambda rows: spark.createDataFrame(rows, "ride_id string, ride_time_secs double, score double")
    sinks.save_moments(make([("a", 2.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 1.0)]), path)
    sinks.save_moments(make([("a", 5.0, 9.0)]), path)
    assert sorted((r["ride_id"], r["ride_time_secs"]) for r in spark.read.parquet(path).collect()) == [("a", 5.0), ("b", 1.0)]
    sinks.save_moments(make([("a", 5.0, 9.0)]), path)
    assert spark.read.parquet(path).count() == 2


def test_variants_and_ranker(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "ride_id string, seq int")
    sinks.save_variants({"greedy": df, "ranked": df}, str(tmp_path / "v"))
    assert {r["variant"] for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"greedy", "ranked"}
    sinks.save_ranker(spark, {"intercept": 0.5, "weights": {"x": 2.0}, "n": 100, "n_positive": 9}, str(tmp_path / "m"))
    assert sinks.load_ranker(spark, str(tmp_path / "m"))["weights"] == {"x": 2.0}


def test_enriched_hits_keep_what_is_there(spark):
    hits = spark.createDataFrame([("r", "a", 1.25, None, None), ("r", "a", 1.0, None, 7.0)], "ride_id string, clip_name string, anchor_video_secs double, video_secs double, ride_time_secs double")
    clips = spark.createDataFrame([("r", "a", 10.0)], "ride_id string, clip_name string, clip_start double")
    assert sorted(r["ride_time_secs"] for r in sinks.enriched_hits(hits, clips).collect()) == [7.0, 11.2]


def test_training_and_reports_replace_their_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1.0), ("r2", 2.0)], "ride_id string, visual double")
    sinks.save_training(rows, str(tmp_path / "t"))
    sinks.save_training(rows.where("ride_id = 'r1'").withColumn("visual", F.lit(9.0)), str(tmp_path / "t"))
    assert {(r["ride_id"], r["visual"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("r1", 9.0), ("r2", 2.0)}
    reports = spark.createDataFrame([("d", "p", "m1", 1), ("d", "p", "m2", 2)], "date_folder string, provider string, model_key string, n int")
    sinks.save_reports(reports, str(tmp_path / "p"))
    sinks.save_reports(reports.where("n = 2").withColumn("n", F.lit(3)), str(tmp_path / "p"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [1, 3]


def test_reviewer_rows_and_manifest(spark):
    c = spark.createDataFrame([("r", f"i{k}", "c", 0.0, 1.0, 0.5, float(k), s, ["x"], "") for k, s in enumerate((0.2, 0.9, 0.9))], "ride_id string, id string, clip_name string, video_start double, video_end double, anchor_video_secs double, ride_time_secs double, score double, sources array<string>, notes string")
    assert [r["id"] for r in sinks.reviewer_rows(c).collect()] == ["i1", "i2", "i0"]
    frames = spark.createDataFrame([("r", 5, "b", 1.0), ("r", 2, "a", 0.0)], "ride_id string, ride_sec int, clip_name string, video_sec double")
    assert [tuple(f) for f in sinks.manifest(frames).first()["frames"]] == [(2, "a", 0.0), (5, "b", 1.0)]


def test_names_of_reports_and_wall_times(spark):
    from trailmark.functions import scalars as s

    row = spark.sql("SELECT 'p' AS p, 'a/b c' AS m, timestamp'2024-05-01 10:00:00' AS t").select(s.report_name(F.col("p"), F.col("m")).alias("name"), s.relabelled(F.col("t")).cast("string").alias("t")).first()
    assert row["name"].startswith("prompt_eval_p_") and row["name"].endswith(".json") and "/" not in row["name"] and row["t"] == "2024-05-01 10:00:00"


def test_validation_tells_signal_from_noise(spark):
    import random

    from trailmark.operators import ranker

    rng = random.Random(1)
    rows = [(f"r{i % 6}", float(x := rng.random()), rng.random(), int(x > 0.5)) for i in range(240)]
    df = spark.createDataFrame(rows, "ride_id string, good double, noise double, selected int")
    assert ranker.validated(df, ["good"]) > 0.95 and abs(ranker.validated(df, ["noise"]) - 0.5) < 0.25
