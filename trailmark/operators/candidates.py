"""Candidates from several sources: scoring, fusion and caps.

The candidate columns are: key, seq (list order), t (ride second), clip_name, video_start, video_end, anchor, score,
source, sources, rubric, notes, must_include.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import VISION_SOURCES, agreement_boost, crop_bias, has_rubric, hit_anchor, liveness_penalty, must_include, num, rubric_score, rubric_total, seconds_between, telemetry_score, type_bonus
from .folds import Fusion, dealt_in_runs, spaced
from .joins import asof_nearest, first_containing

# Priority of sources (0 first), score range of sources without a rubric, bands of the cap.
PRIORITY = {"label": 0, "telemetry": 1, "strava": 2, "clip": 3} | dict.fromkeys(VISION_SOURCES, 4)
LOW_SCORE, HIGH_SCORE = 1.0, 7.0
BAND_LOW, BAND_HIGH = 3.5, 6.5
BLIND_LIMIT = 3.0


def spans(rows: DataFrame, before: float, after: float, anchor: str = "anchor") -> DataFrame:
    return rows.withColumn("video_start", F.greatest(num(0), F.col(anchor) - before)).withColumn("video_end", F.col(anchor) + after)


def from_highlights(found: DataFrame, score10: Column, telemetry: Column, before: float = 1.5, after: float = 1.5) -> DataFrame:
    """Candidates at the peaks of highlights that lie on a clip (clip_name, anchor, t there): ten times the highlight's
    score plus telemetry."""
    rows = found.where((F.col("t") >= 0) & F.col("clip_name").isNotNull()).withColumn("score", score10 * 10 + telemetry).withColumn("source", F.lit("telemetry"))
    return spans(rows, before, after)


def from_efforts(efforts: DataFrame, telemetry: Column, before: float = 1.5, after: float = 1.5) -> DataFrame:
    """Candidates at the middle of segment efforts (start_secs, elapsed_secs, star_count): log of stars plus telemetry."""
    rows = efforts.withColumn("t", F.col("start_secs") + F.col("elapsed_secs") / 2).where((F.col("t") >= 0) & F.col("clip_name").isNotNull())
    rows = rows.withColumn("score", F.log(F.greatest(num(1), F.col("star_count").cast("double"))) + telemetry).withColumn("source", F.lit("strava"))
    return spans(rows, before, after)


def from_labels(labels: DataFrame, telemetry: Column, before: float = 1.5, after: float = 1.5) -> DataFrame:
    """Candidates at labels with a clip and a video second: bonus of the type, or of must-include, plus telemetry."""
    rows = labels.where((F.coalesce("clip_name", F.lit("")) != "") & F.col("video_secs").isNotNull()).withColumn("must_include", must_include(F.col("must_include"), F.col("notes")))
    rows = rows.withColumn("score", telemetry + type_bonus(F.col("type"), F.col("must_include"))).withColumn("source", F.lit("label")).withColumn("anchor", F.col("video_secs"))
    return spans(rows, before, after)


def from_hits(hits: DataFrame, provider: str) -> DataFrame:
    """Candidates from model ratings: anchor within the window, a fifth of the rubric's sum, portrait crop bias."""
    rows = hits.withColumn("anchor", hit_anchor(F.col("video_start"), F.col("video_end"), F.col("peak_offset"))).withColumn("raw_sum", rubric_total(F.col("rubric")))
    return rows.withColumn("score", F.col("raw_sum") / num(5)).withColumn("portrait_crop_bias", crop_bias(F.col("crop_x"), F.col("clip_type"), F.col("rubric.motion"))).withColumn("source", F.lit(provider))


def from_short_clips(clips: DataFrame, telemetry: Column, longest: float = 30.0, key: str = "ride_id") -> DataFrame:
    """Rides whose clips are all short: each clip is a candidate at its middle, telemetry plus 5."""
    short = clips.withColumn("longest", F.max("duration_secs").over(Window.partitionBy(key))).where(F.col("longest") < longest).drop("longest")
    rows = short.withColumn("anchor", F.col("duration_secs") / 2).withColumn("t", F.col("clip_start") + F.col("anchor")).withColumn("score", telemetry + 5).withColumn("source", F.lit("clip"))
    return rows.withColumn("video_start", num(0)).withColumn("video_end", F.col("duration_secs"))


def united(parts: list[DataFrame]) -> DataFrame:
    """Union all of candidate sources, missing columns null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def moving(rows: DataFrame, median_speed_mph: Column, least: float = 5.0) -> DataFrame:
    """Rows whose median speed reaches the least; rows without a speed go; must-includes stay; off at 0 or less."""
    return rows if least <= 0 else rows.where(F.coalesce(F.col("must_include"), F.lit(False)) | F.coalesce(median_speed_mph >= least, F.lit(False)))


def damped(rows: DataFrame, speed: Column, power: Column, has_power: Column) -> DataFrame:
    """Scores less the liveness penalty, where it is above 0.01; labels and must-includes are exempt."""
    exempt = F.coalesce(F.col("must_include"), F.lit(False)) | F.array_contains("sources", "label") | (F.col("source") == "label")
    penalty = F.when(F.coalesce(has_power, F.lit(False)) & ~exempt, liveness_penalty(speed, power)).otherwise(num(0))
    return rows.withColumn("score", F.when(penalty > 0.01, F.col("score") - penalty).otherwise(F.col("score")))


def normalised_scores(rows: DataFrame, key: str = "ride_id", score: str = "score", source: str = "source", rubric: str | None = "rubric") -> DataFrame:
    """Rubric rows take their rubric score; others are scaled to 1-7 within (entity, source); a single value is 4."""
    own = rubric_score(F.col(rubric)) if rubric else F.lit(None).cast("double")
    empty = ~has_rubric(F.col(rubric)) if rubric else F.lit(True)
    w = Window.partitionBy(key, source)
    low, high = (f(F.when(empty, F.col(score).cast("double"))).over(w) for f in (F.min, F.max))
    rows = rows.withColumn("lo", low).withColumn("hi", high)
    span = F.col("hi") - F.col("lo")
    scaled = F.when(span < 1e-6, num((LOW_SCORE + HIGH_SCORE) / 2)).otherwise(LOW_SCORE + (F.col(score) - F.col("lo")) / span * (HIGH_SCORE - LOW_SCORE))
    return rows.withColumn(score, F.coalesce(own, F.when(empty, scaled), F.col(score).cast("double"))).drop("lo", "hi")


FUSED = ("k", "seq", "t", "clip_name", "video_start", "video_end", "anchor", "score", "source", "sources", "rubric", "notes", "must_include")


def fused(rows: DataFrame, key: str = "ride_id", merge: float = 15, label: float = 45, vision: float = 20) -> DataFrame:
    """Candidates of different sources about the same instant become one; see `Fusion` for the rules. A fold in time order over
    streams of islands: a merged entry keeps the time of one of its items, so a gap as wide as the widest window between
    neighbours in time is one that no merge crosses. Then agreement boost and the limit for blind ones."""
    rubric_type = rows.schema["rubric"].dataType
    text = lambda c: F.coalesce(c, F.lit(""))
    scored = rows.withColumn("own_score", rubric_score(F.col("rubric"))).withColumn("rated", has_rubric(F.col("rubric")))
    numbers = [F.col(c).cast("double").alias(c) for c in ("t", "video_start", "video_end", "anchor", "score")]
    sources = F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array("source")).alias("sources")
    narrow = scored.select(F.col(key).alias("k"), F.col("seq").cast("long").alias("seq"), "clip_name", *numbers, "source", sources, F.to_json("rubric").alias("rubric"), text(F.col("notes")).alias("notes"), F.coalesce("must_include", F.lit(False)).alias("must_include"), "own_score", "rated")
    widest = max(merge, label, vision)
    dealt = dealt_in_runs(narrow, "k", "t", F.col("t") - F.col("before") >= widest, ["t", "seq"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_run, fold = None, _fold(merge, label, vision)
        for pdf in batches:
            out = []
            for item in pdf.to_dict("records"):
                at = (item["k"], item.pop("run"))
                if at != open_run:
                    out += fold.end()
                    open_run = at
                out += fold.behind(item["t"])
                fold.add(item | {"sources": list(item["sources"])})
            yield pd.DataFrame(out, columns=FUSED)
        yield pd.DataFrame(fold.end(), columns=FUSED)

    kinds = {"k": rows.schema[key].dataType.simpleString(), "seq": "long", "clip_name": "string", "source": "string", "sources": "array<string>", "rubric": "string", "notes": "string", "must_include": "boolean"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in FUSED)
    found = dealt.mapInPandas(run, schema).withColumn("rubric", F.from_json("rubric", rubric_type)).withColumnRenamed("k", key)
    own = rubric_score(F.col("rubric"))
    found = found.withColumn("score", F.col("score") + agreement_boost(F.col("sources"), own))
    blind = ~has_rubric(F.col("rubric")) & ~F.arrays_overlap("sources", F.array(*map(F.lit, VISION_SOURCES)))
    return found.withColumn("score", F.when(blind, F.least(F.col("score"), num(BLIND_LIMIT))).otherwise(F.col("score")))


def _fold(merge: float, label: float, vision: float) -> Fusion:
    return Fusion(merge, label, vision, VISION_SOURCES, _joined, _kept)


def _fuse(items: list[dict], merge: float, label: float, vision: float) -> list[dict]:
    """The fold of the items of one island."""
    fold = _fold(merge, label, vision)
    for item in items:
        fold.add(item | {"sources": list(item["sources"])})
    return fold.end()


def _kept(entry: dict, item: dict) -> dict:
    """The better of two of one vision source."""
    best = dict(item if item["score"] > entry["score"] else entry)
    return best | _span(best, entry, item)


def _span(winner: dict, a: dict, b: dict) -> dict:
    if a["clip_name"] != b["clip_name"]:
        return {"video_start": winner["video_start"], "video_end": winner["video_end"]}
    return {"video_start": min(a["video_start"], b["video_start"]), "video_end": max(a["video_end"], b["video_end"])}


def _joined(entry: dict, item: dict) -> dict:
    rank = lambda s: PRIORITY.get(s, 99)
    winner, loser = (item, entry) if rank(item["source"]) < rank(entry["source"]) else (entry, item)
    sources = sorted(set(entry["sources"]) | set(item["sources"]))
    out = winner | _span(winner, entry, item) | {"sources": sources, "source": min(sources, key=rank), "must_include": winner["must_include"]}
    if not winner["rated"] and loser["rated"]:
        out |= {k: loser[k] for k in ("rubric", "rated", "own_score")}
    if loser["notes"] and loser["notes"] != winner["notes"]:
        out["notes"] = f"{winner['notes']} + {loser['notes']}" if winner["notes"] else loser["notes"]
    own = [x for x in (winner["own_score"], loser["own_score"]) if x is not None and x == x]
    out["score"] = own[0] if own else max(winner["score"], loser["score"])
    return out


def capped(rows: DataFrame, limit: int = 90, top_share: float = 0.6, key: str = "ride_id", score: str = "score", seq: str = "seq", must: str | None = "must_include") -> DataFrame:
    """At most `limit` rows for an entity, as a feature: must-includes, then the best up to the top share of the limit, then
    in turn from the low, middle and high scores, best first in each. All columns of `rows` stay."""
    kept = F.coalesce(F.col(must), F.lit(False)) if must else F.lit(False)
    w = Window.partitionBy(key)
    rows = rows.withColumn("cap_must0", kept).withColumn("cap_n_must", F.count_if("cap_must0").over(w)).withColumn("cap_n_all", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("cap_rank0", F.row_number().over(Window.partitionBy(key, "cap_must0").orderBy(F.desc(score), seq)))
    quota = F.greatest(F.lit(0), F.floor(F.lit(limit * top_share)).cast("int") - F.col("cap_n_must"))
    rows = rows.withColumn("cap_stage", F.when(F.col("cap_n_all") <= limit, 0).when(F.col("cap_must0"), 0).when(F.col("cap_rank0") <= quota, 1).otherwise(2))
    band = F.when(F.col(score) < BAND_LOW, 0).when(F.col(score) < BAND_HIGH, 1).otherwise(2)
    rows = rows.withColumn("cap_band", band).withColumn("cap_turn", F.row_number().over(Window.partitionBy(key, "cap_stage", "cap_band").orderBy(F.desc(score), seq)))
    place = F.row_number().over(Window.partitionBy(key).orderBy("cap_stage", F.when(F.col("cap_stage") == 2, F.col("cap_turn")).otherwise(F.col("cap_rank0")), F.when(F.col("cap_stage") == 2, F.col("cap_band")).otherwise(0), seq))
    return rows.withColumn("cap_place", place).where((F.col("cap_place") <= limit) | F.col("cap_must0")).drop("cap_must0", "cap_n_must", "cap_n_all", "cap_rank0", "cap_stage", "cap_band", "cap_turn", "cap_place")


def fillers(samples: DataFrame, taken: DataFrame, needed: DataFrame, gap: float = 10.0, factor: float = 0.05, most: float = 0.9, key: str = "ride_id", step: float | None = None) -> DataFrame:
    """`samples` (t, score and others) with score min(factor * score, most): those with a score above 0, the best first, the
    earlier on ties, at least `gap` from every time taken or accepted, until `n_needed` of the entity are found.

    Where samples stand on a grid of `step` seconds, a time taken or accepted excludes 2 * ceil(gap / step) - 1 of them at most,
    or as many as 2 * gap / step if it is off the grid, so only so many of the best can matter and the entity's group is bounded
    by what is needed and taken. The fold is sequential within an entity.
    """
    columns = [c for c in samples.columns if c not in (key, "t", "score")]
    wanted = needed.select(key, F.col("n_needed").cast("long").alias("n_needed")).where("n_needed > 0")
    have = taken.join(wanted, key, "left_semi").groupBy(key).agg(F.collect_list(F.col("t").cast("double")).alias("taken"))
    rows = samples.where("score > 0").withColumn("t", F.col("t").cast("double")).withColumn("score", F.col("score").cast("double")).join(wanted, key)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "t")))
    if step:
        out = 2 * math.ceil(gap / step) + 1
        counts = have.select(key, F.size("taken").alias("n_taken"))
        rows = rows.join(counts, key, "left").where(F.col("place") <= F.col("n_needed") + out * (F.col("n_needed") + F.coalesce("n_taken", F.lit(0)))).drop("n_taken")
    best = rows.select(F.col(key).alias("k"), "n_needed", "t", "place").join(have.withColumnRenamed(key, "k"), "k", "left")
    picks = best.groupBy("k").agg(F.max("n_needed").alias("n"), F.array_sort(F.collect_list(F.struct("place", "t"))).alias("ranked"), F.first("taken").alias("taken"))

    @F.pandas_udf("array<int>")
    def accepted(ns: pd.Series, ranked: pd.Series, taken: pd.Series) -> pd.Series:
        return pd.Series([spaced([(x["t"], x["place"]) for x in r], list(have) if have is not None else [], gap, n) for n, r, have in zip(ns, ranked, taken, strict=True)])

    kept = picks.select(F.col("k").alias(key), F.explode(accepted("n", "ranked", "taken")).alias("place"))
    found = rows.join(kept, [key, "place"])
    return found.select(key, "t", F.least(factor * F.col("score"), num(most)).alias("score"), *columns, *([F.col("score").alias("raw_score")] if "raw_score" not in columns else []))


def telemetry_fillers(points: DataFrame, clips: DataFrame, taken: DataFrame, needed: DataFrame, before: float = 1.5, after: float = 1.5, step: float = 5.0, gap: float = 10.0, key: str = "ride_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Filler candidates of entities that need more: every `step` seconds from the start to the last point, the nearest point's
    telemetry is scored; of the samples on a clip (clip_name, clip_start, clip_end, in seconds of the ride) the best are taken
    by `fillers`. Columns are those of candidates: t, clip_name, anchor, video_start, video_end, score, source, sources, notes."""
    short = needed.where("n_needed > 0").select(key)
    base = points.join(short, key, "left_semi").groupBy(key).agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    last = F.floor(seconds_between(F.col("t0"), F.col("t1")) / step).cast("int")
    grid = base.select(key, "t0", F.explode(F.sequence(F.lit(0), last)).alias("i")).withColumn("t", F.col("i") * num(step))
    grid = grid.withColumn("probe_ts", F.col("t0") + F.make_dt_interval(secs=F.col("t").cast("decimal(18,6)")))
    told = asof_nearest(grid.select(key, "t", "probe_ts"), points, ["power", "speed", "heart_rate"], key=key, ts=ts, seq=seq)
    scored = told.select(key, "t", telemetry_score(F.col("power"), F.col("speed"), F.col("heart_rate")).alias("score")).where("score > 0")
    placed = first_containing(scored, clips, key=key, at="t").select(key, "t", "score", "clip_name", F.col("video_secs").alias("anchor"))
    found = spans(fillers(placed, taken, needed, gap, key=key, step=step), before, after)
    note = F.format_string("filler (telemetry score %.1f)", F.bround("raw_score", 1))
    return found.withColumns({"source": F.lit("filler"), "sources": F.array(F.lit("filler")), "notes": note}).drop("raw_score")


def moments(rows: DataFrame, key: str = "ride_id", stable: str = "stable_id", seq: str = "seq") -> DataFrame:
    """One row per stable id: the first in list order with the union of sources; score of the highest (first on ties),
    with its rubric and notes unless they are empty."""
    firsts = [c for c in rows.columns if c not in (key, stable, seq, "score", "sources", "rubric", "notes")]
    high = F.struct("score", -F.col(seq))
    present = lambda c, ok: F.coalesce(F.max_by(c, F.when(ok, high)), F.min_by(c, seq)).alias(c)
    extra = ([present("rubric", has_rubric(F.col("rubric")))] if "rubric" in rows.columns else []) + ([present("notes", F.coalesce("notes", F.lit("")) != "")] if "notes" in rows.columns else [])
    return rows.groupBy(key, stable).agg(*[F.min_by(c, seq).alias(c) for c in firsts], F.min(seq).alias(seq), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.max("score").alias("score"), *extra)
