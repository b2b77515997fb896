"""Order-dependent kernels against short sequential restatements on random inputs."""

import datetime as dt
import math
import random

import pandas as pd

from trailmark.operators import candidates, joins, selection, timeseries


def series(spark, seed, rides=4, n=60):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for ride in range(rides):
        t = 0
        for seq in range(n):
            t += rng.choice([0, 1, 3, 10, 40])
            rows.append((ride, seq, start + dt.timedelta(seconds=t), rng.choice([None, 5.0, 11.0, 13.0, 14.0, 30.0])))
    return rows, spark.createDataFrame(rows, "ride_id long, seq long, ts timestamp_ntz, v double")


def test_sustained_runs_like_a_scan(spark):
    for seed in range(3):
        rows, df = series(spark, seed)
        want = []
        for ride in {r[0] for r in rows}:
            run = []
            for _, _, ts, v in sorted((r for r in rows if r[0] == ride), key=lambda r: (r[2], r[1])):
                ok = v is not None and 12 <= v <= 22
                if ok:
                    run.append((ts, v))
                elif run:
                    if (ts - run[0][0]).total_seconds() >= 10:
                        peak = max(x for _, x in run)
                        want.append((ride, run[0][0], ts, peak, next(t for t, x in run if x == peak)))
                    run = []
        got = timeseries.threshold_runs(df, "v", 12, 10, "speed_spike", 22).collect()
        assert sorted((r["ride_id"], r["start_ts"], r["end_ts"], r["peak_value"], r["peak_ts"]) for r in got) == sorted(want)


def test_asof_ties(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    points = spark.createDataFrame([(1, 0, t(0), 1), (1, 1, t(10), 2), (1, 2, t(10), 3), (1, 3, t(20), 4)], "ride_id long, seq long, ts timestamp_ntz, v int")
    probes = spark.createDataFrame([(1, 1, t(5)), (1, 2, t(10)), (1, 3, t(-9)), (1, 4, t(16)), (2, 5, t(0))], "ride_id long, id long, probe_ts timestamp_ntz")
    got = {r["id"]: r["v"] for r in joins.asof_nearest(probes, points, ["v"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: None}
    later = {r["id"]: r["v"] for r in joins.asof_nearest(probes, points, ["v"], later_wins=True).collect()}
    assert later[1] == 2
    near = {r["id"]: r["v"] for r in joins.asof_nearest(probes, points, ["v"], tolerance_secs=4).collect()}
    assert near == {1: None, 2: 2, 3: None, 4: 4, 5: None}


def test_greedy_match_like_a_loop(spark):
    for seed in range(3):
        rng = random.Random(seed)
        labels = [(r, i, float(rng.randrange(100))) for r in range(3) for i in range(12)]
        hits = [(r, 100 + i, float(rng.randrange(100))) for r in range(3) for i in range(15)]
        want = set()
        for ride in range(3):
            free = sorted((t, i) for r, i, t in hits if r == ride)
            for t, i in sorted((t, i) for r, i, t in labels if r == ride):
                near = [h for h in free if abs(h[0] - t) <= 7]
                if near:
                    best = min(near, key=lambda h: (abs(h[0] - t), h))
                    free.remove(best)
                    want.add((ride, i, best[1], "matched"))
                else:
                    want.add((ride, i, None, "label_only"))
            want |= {(ride, None, i, "model_only") for _, i in free}
        got = joins.greedy_match(spark.createDataFrame(labels, "ride_id long, label_id long, t double"), spark.createDataFrame(hits, "ride_id long, hit_id long, t double"), 7.0)
        assert {tuple(r) for r in got.collect()} == want


def test_selection_keeps_the_floor_and_fills_up():
    rng = random.Random(5)
    pool = [{"seq": i, "t": rng.random() * 500, "score": rng.random() * 8, "boost": 0.0, "must_include": i % 40 == 0, "rank0": 0} for i in range(80)]
    picks = selection.chosen(pool, 15, 60.0)
    assert len(picks) == 15
    free = [p for p in picks if not p["must_include"]]
    assert all(abs(a["t"] - b["t"]) >= selection.FLOOR_SECS for a in free for b in picks if a is not b)
    assert [p["t"] for p in picks] == sorted(p["t"] for p in picks)
    assert {p["seq"] for p in pool if p["must_include"]} <= {p["seq"] for p in picks}


def test_greedy_takes_the_best_first():
    pool = [{"seq": i, "t": t, "score": sc, "boost": 0.0, "must_include": False, "rank0": 0} for i, (t, sc) in enumerate([(0.0, 9.0), (1.0, 8.9), (300.0, 2.0), (20.0, 8.0)])]
    picks = selection.chosen(pool, 2, 60.0)
    first = 8.0 - selection.CROWD_WEIGHT * math.exp(-20 / 60)
    assert [p["seq"] for p in picks] == ([0, 3] if first > 2.0 - selection.CROWD_WEIGHT * math.exp(-5) else [0, 2])


def test_backfill_takes_the_widest_gap():
    pool = [{"seq": i, "t": t, "score": sc, "boost": 0, "must_include": False, "rank0": 0} for i, (t, sc) in enumerate([(0, 1), (500, 1), (700, 1), (250, 3), (260, 5), (600, 9)])]
    assert [p["seq"] for p in selection.backfilled(pool[:3], pool, 4)] == [0, 1, 2, 4]


def item(seq, t, source, score=1.0, **more):
    return {"k": 1, "seq": seq, "t": t, "clip_name": "a", "video_start": t - 1, "video_end": t + 1, "anchor": t, "score": score, "source": source, "sources": [source], "rubric": None, "notes": f"n{seq}", "must_include": False, "own_score": None, "rated": False} | more


def test_fusion_rules():
    out = candidates._fuse([item(0, 0, "telemetry"), item(1, 10, "strava", 3.0), item(2, 14, "gemini", 2.0, rated=True, own_score=6.0, rubric="r")], 15, 45, 20)
    assert len(out) == 1
    one = out[0]
    assert one["source"] == "telemetry" and one["sources"] == ["gemini", "strava", "telemetry"]
    assert one["score"] == 6.0 and one["rubric"] == "r" and one["notes"] == "n0 + n1 + n2"
    assert (one["video_start"], one["video_end"]) == (-1, 15)
    assert len(candidates._fuse([item(0, 0, "telemetry"), item(1, 15, "strava")], 15, 45, 20)) == 2  # strict
    assert len(candidates._fuse([item(0, 0, "label"), item(1, 44, "strava")], 15, 45, 20)) == 1
    same = candidates._fuse([item(0, 0, "gemini", 1.0), item(1, 19, "gemini", 2.0)], 15, 45, 20)
    assert [(x["seq"], x["score"]) for x in same] == [(1, 2.0)]
    assert len(candidates._fuse([item(0, 0, "telemetry"), item(1, 5, "telemetry")], 15, 45, 20)) == 2


def test_fillers_keep_apart(spark):
    samples = spark.createDataFrame([(1, float(t), 10.0 - t / 10) for t in range(0, 60, 5)], "ride_id long, t double, score double")
    taken = spark.createDataFrame([(1, 20.0)], "ride_id long, t double")
    need = spark.createDataFrame([(1, 3)], "ride_id long, n_needed int")
    got = sorted((r["t"], r["score"]) for r in candidates.fillers(samples, taken, need).collect())
    assert [t for t, _ in got] == [0.0, 10.0, 30.0]
    assert got[0][1] == 0.5


def test_injected_and_coverage_times(spark):
    df = spark.createDataFrame([([10.0], [12.0, 20.0, 24.0, 25.0], 100.0)], "hot array<double>, forced array<double>, d double")
    row = df.select(timeseries.injected_times(df["hot"], df["forced"]).alias("x"), timeseries.coverage_times(df["d"]).alias("c")).first()
    assert row["x"] == [10.0, 20.0, 25.0]
    assert row["c"] == [5.0, 50.0, 95.0]


def test_merge_names_the_crest(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, t(0), t(20), "climb", 0.4, 20.0, t(20)), (1, t(25), t(40), "speed_spike", 0.9, 14.0, t(30)), (1, t(100), t(110), "climb", 0.5, 16.0, t(110))]
    df = spark.createDataFrame(rows, "ride_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, reason string, score double, peak_value double, peak_ts timestamp_ntz")
    got = sorted(timeseries.merge_intervals(df, 15).collect(), key=lambda r: r["start_ts"])
    assert [(r["reason"], r["description"], r["n_merged"]) for r in got] == [("speed_spike", "descent over crest", 2), ("climb", None, 1)]
    assert got[0]["end_ts"] == t(40) and got[0]["peak_value"] == 14.0


def test_scoring_counts_failures(spark):
    from trailmark.operators import scoring

    def coarse(batch: pd.DataFrame) -> pd.DataFrame:
        if batch["clip_name"].iloc[0] == "bad":
            raise ValueError("refused")
        return pd.DataFrame({"frame_index": [0, 1, 99], "visual": [5, 2, 5], "action": [1, 2, 5]})

    clips = spark.createDataFrame([("ok", 100.0), ("bad", 20.0)], "clip_name string, duration_secs double")
    frames = spark.createDataFrame([(c, float(t)) for c in ("ok", "bad") for t in (0, 10)], "clip_name string, t double")
    scores = scoring.coarse_scores(frames, coarse)
    tally = {r["clip_name"]: (r["n_errors"], r["degraded"]) for r in scoring.tally(scores, clips).collect()}
    assert tally == {"ok": (0, False), "bad": (1, True)}
    assert [r["t"] for r in scores.where("error is null").collect()] == [0.0]
    windows = scoring.hot_windows(scores, clips).where("clip_name = 'ok'").orderBy("region_start").collect()
    assert [(w["region_start"], w["region_end"]) for w in windows] == [(0.0, 10.0), (45.0, 55.0), (90.0, 100.0)]
    assert {r["clip_name"] for r in scoring.cacheable(scores, scoring.tally(scores, clips)).collect()} == {"ok"}


def test_retry_waits_for_transient_errors():
    from trailmark.operators import scoring

    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise scoring.TransientError("busy")
        return batch

    result, error = scoring.with_retry(flaky, wait=0.0)(pd.DataFrame({"a": [1]}))
    assert error is None and len(result) == 1 and len(calls) == 3


def test_first_containing_like_a_scan_and_without_standing_in_buckets(spark):
    rng = random.Random(7)
    clips = [(rng.randrange(3), i, float(a), a + rng.choice([0.0, 3.0, 20.0, 400.0])) for i, a in enumerate(rng.choices(range(300), k=120))] + [(None, 900, 0.0, 999.0), (0, 901, 9.0, 8.0), (1, 902, None, 5.0)]
    probes = [(rng.choice([0, 1, 2, 3, None]), i, rng.choice([None, float(rng.randrange(700))])) for i in range(300)]
    probes += probes[:20]  # equal rows each keep their own
    want = []
    for k, i, x in probes:
        on = [(a, c) for key, c, a, b in clips if None not in (k, x, a) and key == k and a <= x <= b]
        want.append((k, i, x, min(on)[1] if on else None, x - min(on)[0] if on else None))
    df = spark.createDataFrame(clips, "ride_id long, clip_name long, clip_start double, clip_end double")
    asked = spark.createDataFrame(probes, "ride_id long, seq long, at_secs double")
    order = lambda rows: sorted(map(str, map(tuple, rows)))
    assert order(joins.first_containing(asked, df, how="left").collect()) == order(want)
    assert order(joins.first_containing(asked, df).collect()) == order(w for w in want if w[3] is not None)
    # A clip of 30,000 years: by buckets of ten minutes it stood in more than a billion rows.
    long = spark.createDataFrame([(1, 7, 0.0, 1e12)], "ride_id long, clip_name long, clip_start double, clip_end double")
    far = spark.createDataFrame([(1, 1, 9e11), (1, 2, 2e12)], "ride_id long, seq long, at_secs double")
    assert [(r["seq"], r["clip_name"]) for r in joins.first_containing(far, long).collect()] == [(1, 7)]


def test_groups_of_a_stream_are_whole_and_apart():
    from trailmark.operators import scoring

    rng = random.Random(3)
    for _ in range(30):
        rows = sorted((rng.choice(["a", "b", "c"]), rng.randrange(3), float(rng.randrange(9))) for _ in range(rng.randrange(1, 40)))
        pdf = pd.DataFrame(rows, columns=["clip_name", "batch_id", "t"])
        cuts = sorted({0, len(rows), *[rng.randrange(len(rows) + 1) for _ in range(5)]})
        parts = [pdf.iloc[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)] + [pdf.iloc[:0]]
        got = [list(g.itertuples(index=False, name=None)) for g in scoring.each_group(iter(parts), ["clip_name", "batch_id"])]
        want = [[r for r in rows if r[:2] == k] for k in sorted({r[:2] for r in rows})]
        assert got == want


def test_scoring_streams_its_batches(spark):
    """A batch was a group of its own, at the price of a round trip to Python each."""
    from trailmark.operators import scoring

    frames = spark.createDataFrame([(f"clip {c}", float(t)) for c in range(9) for t in range(70)], "clip_name string, t double")
    scores = scoring.coarse_scores(frames, lambda pdf: pd.DataFrame({"frame_index": range(len(pdf)), "visual": 3, "action": 1}))
    assert scores.count() == 630 and scores.select("clip_name", "batch_id").distinct().count() == 18
    plan = scores._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    assert scores.rdd.getNumPartitions() == 4  # few bytes aren't put into one task


def test_clips_stand_in_few_buckets_however_long(spark):
    from trailmark.operators import aggregates

    rng = random.Random(11)
    clips = [(rng.randrange(2), i, float(a), a + rng.choice([0.0, 5.0, 62.0, 63.0, 4000.0])) for i, a in enumerate(rng.choices(range(5000), k=40))] + [(1, 99, 5.0, 1e12)]
    points = [(rng.randrange(3), i, rng.randrange(90000) / 10) for i in range(200)]
    want = sorted((k, c, i) for k, c, a, b in clips for key, i, x in points if key == k and a - 1 <= x <= b + 1)
    df = spark.createDataFrame(clips, "ride_id long, clip_name long, clip_start double, clip_end double")
    got = aggregates.clip_payload(df, spark.createDataFrame(points, "ride_id long, seq long, at_secs double"))
    assert sorted((r["ride_id"], r["clip_name"], r["seq"]) for r in got.collect()) == want


def test_asof_like_a_scan(spark):
    """Both kinds of ties, points of one instant, points and probes without a time, by one sort of both sides."""
    start = dt.datetime(2024, 1, 1)
    t = lambda s: None if s is None else start + dt.timedelta(microseconds=s)
    for seed in range(2):
        rng = random.Random(seed)
        times = lambda n, none: [None if rng.random() < none else rng.randrange(40) for _ in range(n)]
        points = [(ride, seq, at) for ride in range(8) for seq, at in enumerate(times(rng.randrange(8), 0.2))] + [(20, seq, None) for seq in (2, 1)]
        probes = [(ride, i, at) for ride in [*range(9), 20] for i, at in enumerate(times(12, 0.1))]
        df = spark.createDataFrame([(r, s, t(at)) for r, s, at in points], "ride_id long, seq long, ts timestamp_ntz")
        asked = spark.createDataFrame([(r, i, t(at)) for r, i, at in probes], "ride_id long, i long, probe_ts timestamp_ntz")
        for later in (False, True):
            want = {}
            for ride, i, x in probes:
                own = [(at, s) for r, s, at in points if r == ride]
                timed = [(at, s) for at, s in own if at is not None]
                side = lambda p: -p[0] if later else p[0]
                near = min(timed, key=lambda p: (abs(p[0] - x), side(p), p[1]) if x is not None else p) if timed else min(own, key=lambda p: p[1], default=(None, None))
                want[ride, i] = near[1]
            out = joins.asof_nearest(asked, df, ["seq"], later_wins=later)
            got = out.collect()
            assert len(got) == len(probes) and {(r["ride_id"], r["i"]): r["seq"] for r in got} == want
            assert all((r["asof_gap"] is None) == (r["probe_ts"] is None or r["asof_ts"] is None) for r in got)
        # The united sides are sorted once; a sort of points alone comes before.
        unions = out._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
        assert unions.count("Window") == 1
