"""Folds over streams of runs against plain loops over whole entities."""

import math
import random
import time

import pytest

from trailmark.operators import candidates, folds, joins, selection

from .test_kernels import item


def fused_by_hand(items, merge, label, vision):
    """Every item against all entries from the front."""
    entries = []
    for x in items:
        x = x | {"sources": list(x["sources"])}
        for i, e in enumerate(entries):
            gap = abs(x["t"] - e["t"])
            if x["source"] != e["source"]:
                if gap < (label if "label" in x["sources"] + e["sources"] else merge):
                    entries[i] = candidates._joined(e, x)
                    break
            elif x["source"] in candidates.VISION_SOURCES and gap < vision:
                best = dict(x if x["score"] > e["score"] else e)
                entries[i] = best | candidates._span(best, e, x)
                break
        else:
            entries.append(x)
    return entries


def some_items(seed, n, spread):
    rng = random.Random(seed)
    times = sorted(rng.choice([rng.random() * spread, float(rng.randrange(int(spread)))]) for _ in range(n))
    out = []
    for i, t in enumerate(times):
        source = rng.choice(["label", "telemetry", "telemetry", "strava", "gemini", "openai"])
        rated = source in candidates.VISION_SOURCES and rng.random() < 0.7
        out.append(item(i, t, source, rng.choice([1.0, 2.0, 3.5, 6.0]), clip_name=rng.choice("ab"), rated=rated, own_score=rng.random() * 9 if rated else None))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_fusion_like_all_entries(seed):
    items = some_items(seed, 80, 400 if seed % 2 else 4000)
    for windows in ((15, 45, 20), (45, 10, 30), (5, 5, 60)):
        assert candidates._fuse(items, *windows) == fused_by_hand(items, *windows)


def test_fusion_in_islands_like_whole_rides(spark):
    rows, want = [], set()
    for ride in range(6):
        items = some_items(100 + ride, 150, 6000)
        rows += [(ride, x["seq"], x["t"], x["clip_name"], x["video_start"], x["video_end"], x["anchor"], x["score"], x["source"], x["notes"]) for x in items]
        plain = [x | {"rated": False, "own_score": None} for x in items]
        want |= {(ride, x["seq"], x["t"], tuple(x["sources"]), x["source"], x["video_start"], x["video_end"], x["notes"]) for x in fused_by_hand(plain, 15, 45, 20)}
    df = spark.createDataFrame(rows, "ride_id long, seq long, t double, clip_name string, video_start double, video_end double, anchor double, score double, source string, notes string")
    df = df.selectExpr("*", "array(source) AS sources", "cast(null AS struct<light:int,composition:int,motion:int,scenery:int,subject:int>) AS rubric", "false AS must_include")
    got = {(r["ride_id"], r["seq"], r["t"], tuple(r["sources"]), r["source"], r["video_start"], r["video_end"], r["notes"]) for r in candidates.fused(df.repartition(3)).collect()}
    assert got == want


def test_fusion_takes_time_in_proportion():
    took = {}
    for n in (4000, 16000):
        items = [item(i, i * 0.001, "telemetry") for i in range(n)]  # all within a window, none of which merges
        began = time.perf_counter()
        assert len(candidates._fuse(items, 15, 45, 20)) == n
        took[n] = time.perf_counter() - began
    assert took[16000] < 8 * took[4000] + 0.2


def test_entries_that_fell_behind_leave():
    fold = candidates._fold(15, 45, 20)
    out = []
    for i in range(5000):
        out += fold.behind(i * 10.0)
        fold.add(item(i, i * 10.0, "telemetry"))
    assert len(fold.entries) < 1100 and len(out) + len(fold.end()) == 5000


def matched_by_hand(labels, hits, window):
    free, out = sorted((t, i) for i, t in hits if t is not None), []
    for t, i in sorted((t, i) for i, t in labels if t is not None):
        near = [h for h in free if abs(h[0] - t) <= window]
        best = min(near, key=lambda h: (abs(h[0] - t), h), default=None)
        out.append((i, best and best[1], "matched" if best else "label_only"))
        if best:
            free.remove(best)
    out += [(None, i, "model_only") for _, i in free]
    return {*out, *((i, None, "label_only") for i, t in labels if t is None), *((None, i, "model_only") for i, t in hits if t is None)}


def test_matching_like_a_loop_over_dense_and_sparse_rides(spark):
    rng = random.Random(8)
    when = lambda spread: None if rng.random() < 0.03 else float(rng.randrange(spread))
    labels = [(ride, i, when(spread)) for ride, spread in ((1, 40), (2, 5000), (3, 300)) for i in range(150)]
    hits = [(ride, 1000 + i, when(spread)) for ride, spread in ((1, 40), (2, 5000), (3, 300), (4, 9)) for i in range(200)]
    got = joins.greedy_match(spark.createDataFrame(labels, "ride_id long, label_id long, t double"), spark.createDataFrame(hits, "ride_id long, hit_id long, t double"), 7.0).collect()
    want = {(ride, *x) for ride in (1, 2, 3, 4) for x in matched_by_hand([r[1:] for r in labels if r[0] == ride], [r[1:] for r in hits if r[0] == ride], 7.0)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_spaced_like_all_pairs():
    rng = random.Random(3)
    for _ in range(50):
        taken = [rng.randrange(300) for _ in range(rng.randrange(5))]
        ranked = [(float(rng.randrange(60) * 5), i) for i in range(60)]
        have, want = list(taken), []
        for t, i in ranked:
            if len(want) < 8 and all(abs(t - x) >= 10 for x in have):
                have.append(t)
                want.append(i)
        assert folds.spaced(ranked, taken, 10, 8) == want


def chosen_by_hand(pool, n, tau, ranked):
    """Crowding from scratch for each candidate and pick."""
    s = selection
    value = lambda c: c["score"] + c["boost"]
    crowd = lambda c, picks: min(sum(math.exp(-abs(c["t"] - p["t"]) / tau) for p in picks), s.CROWD_LIMIT)
    clear = lambda c, picks: all(abs(c["t"] - p["t"]) >= s.FLOOR_SECS for p in picks)
    worth = lambda c, picks: value(c) - s.CROWD_WEIGHT * crowd(c, picks)
    picks = [c for c in pool if c["must_include"]]
    if ranked and any(c["rank0"] > 0 for c in pool):
        for c in sorted((c for c in pool if c["rank0"] > 0), key=value, reverse=True):
            if c not in picks and clear(c, picks) and worth(c, picks) >= 0:
                picks.append(c)
        while 2 <= len(picks) < n:
            picks.sort(key=lambda p: p["t"])
            gaps = []
            for a, b in zip(picks, picks[1:]):
                inside = [c for c in pool if c not in picks and a["t"] + s.EDGE_PAD <= c["t"] <= b["t"] - s.EDGE_PAD]
                if b["t"] - a["t"] > s.WIDE_GAP and inside:
                    gaps.append((b["t"] - a["t"], max(inside, key=lambda c: c["score"])))
            if not gaps:
                break
            picks.append(max(gaps, key=lambda g: g[0])[1])
        if len(picks) >= n:
            return sorted(picks, key=lambda p: p["t"])[:n]
    while len(picks) < n:
        best = max((c for c in pool if c not in picks and clear(c, picks)), key=lambda c: worth(c, picks), default=None)
        if best is None or worth(best, picks) < 0:
            break
        picks.append(best)
    while len(picks) < n:
        far = lambda c: min((abs(c["t"] - p["t"]) for p in picks), default=1e9) + s.FILL_WEIGHT * c["score"]
        best = max((c for c in pool if c not in picks and clear(c, picks)), key=far, default=None)
        if best is None:
            break
        picks.append(best)
    return sorted(picks, key=lambda p: p["t"])[:n]


@pytest.mark.parametrize("seed", range(40))
def test_selection_like_crowding_from_scratch(seed):
    rng = random.Random(seed)
    spread = rng.choice([60, 600, 6000])
    pool = [{"seq": i, "t": rng.random() * spread, "score": rng.random() * 9 - 1, "boost": rng.choice([0.0, 0.0, 6.0]), "must_include": rng.random() < 0.05, "rank0": rng.choice([0, 0, i + 1])} for i in range(rng.randrange(90))]
    pool.sort(key=lambda c: c["t"])
    for ranked in (False, True):
        for n in (1, 10, 25):
            assert [c["seq"] for c in selection.chosen(pool, n, 90.0, ranked)] == [c["seq"] for c in chosen_by_hand(pool, n, 90.0, ranked)]


def test_pools_are_told_apart(spark):
    rng = random.Random(4)
    rows = [(ride, i, rng.random() * 900, rng.random() * 8) for ride in (1, 2, None) for i in range(50)]
    df = spark.createDataFrame(rows, "ride_id long, seq long, t double, score double")
    got = selection.selected(df.selectExpr("*", "explode(array('a', 'b')) AS layout"), 12, layout="layout").collect()
    want = set()
    for ride in (1, 2, None):
        pool = sorted(({"seq": r[1], "t": r[2], "score": r[3], "boost": 0.0, "must_include": False, "rank0": 0} for r in rows if r[0] == ride), key=lambda c: c["t"])
        picks = chosen_by_hand(pool, 12, max(60.0, (pool[-1]["t"] - pool[0]["t"]) / 12), False)
        want |= {(ride, layout, c["seq"], c["t"], c["score"], i) for layout in "ab" for i, c in enumerate(picks, 1)}
    assert {tuple(r) for r in got} == want
    assert selection.selected(df.limit(0), 12).count() == 0


def test_the_cap_keeps_all_columns(spark):
    rows = spark.createDataFrame([(1, i, float(i % 9), i % 7 == 0, i, i + 1, -i) for i in range(120)], "ride_id long, seq long, score double, must_include boolean, rank0 int, place int, band int")
    out = candidates.capped(rows, 40)
    assert out.columns == rows.columns
    assert all((r["rank0"], r["place"], r["band"]) == (r["seq"], r["seq"] + 1, -r["seq"]) for r in out.collect())
