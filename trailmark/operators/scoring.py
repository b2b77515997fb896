"""Batch scoring by a user's callable: a coarse pass over frames, a fine pass over the windows it finds.

The scorer stands in for any model client: it takes a pandas DataFrame of one batch and returns one of results, and may
raise. Transient errors are retried with growing waits; hard failures become rows with a message, which are counted per
clip, so that retried tasks count nothing twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import RUBRIC_DIMS, bound, json_found, num
from .joins import batches
from .timeseries import coverage_times, injected_times, merge_regions

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


class TransientError(Exception):
    """Worth another try: rate limits, server errors and timeouts."""


def with_retry(scorer: Scorer, tries: int = 5, wait: float = 5.0, transient: tuple = (TransientError, TimeoutError, ConnectionResetError)) -> Callable[[pd.DataFrame], tuple[pd.DataFrame | None, str | None]]:
    """(result, None), or (None, message) once an error is hard or the tries are spent."""

    def call(batch: pd.DataFrame):
        for k in range(tries):
            try:
                return scorer(batch), None
            except transient as e:
                if k == tries - 1:
                    return None, f"{type(e).__name__}: {e}"
                time.sleep(wait * 2**k)
            except Exception as e:  # any other failure of a user's callable is hard, and reported in its row
                return None, f"{type(e).__name__}: {e}"
        return None, "no try"

    return call


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt by `keys` to as many tasks as the session's shuffles have: rows are few bytes and much work, and by bytes
    adaptive execution would put them all into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def each_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a stream of sorted rows, one pandas DataFrame each; the last of a batch may go on in the next. A group costs
    a slice, not a round trip of its own as with `applyInPandas`."""
    open_group = []
    for pdf in batches:
        if not len(pdf):
            continue
        columns = [pdf[k] for k in keys]
        changed = reduce(lambda x, y: x | y, ((c.ne(c.shift()) & ~(c.isna() & c.shift().isna())) for c in columns)).to_numpy(dtype=bool)
        changed[0] = False
        bounds = [0, *changed.nonzero()[0].tolist(), len(pdf)]
        if open_group:
            last = open_group[-1]
            if any(not _same(last[k].iloc[-1], pdf[k].iloc[0]) for k in keys):
                yield pd.concat(open_group, ignore_index=True) if len(open_group) > 1 else last
                open_group = []
        for i, j in zip(bounds[:-2], bounds[1:-1], strict=True):
            part = pdf.iloc[i:j].reset_index(drop=True)
            yield pd.concat([*open_group, part], ignore_index=True) if open_group else part
            open_group = []
        open_group.append(pdf.iloc[bounds[-2] :].reset_index(drop=True))
    if open_group:
        yield pd.concat(open_group, ignore_index=True) if len(open_group) > 1 else open_group[0]


def _same(a, b) -> bool:
    return bool(a == b) if not (pd.isna(a) or pd.isna(b)) else bool(pd.isna(a) and pd.isna(b))


def _tables(rows: Iterator[list[tuple]], columns: list[str], whole: tuple[str, ...], size: int = 10_000) -> Iterator[pd.DataFrame]:
    """Rows of results, put together to DataFrames of about `size` rows."""
    out = []
    for found in rows:
        out += found
        if len(out) >= size:
            yield pd.DataFrame(out, columns=columns).astype(dict.fromkeys(whole, "Int64"))
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns).astype(dict.fromkeys(whole, "Int64"))


def coarse_scores(frames: DataFrame, scorer: Scorer, size: int = 50, wait: float = 5.0) -> DataFrame:
    """(clip_name, batch_id, frame_index, t, visual, action, error) for frames (clip_name, t) in batches: results with an
    index outside the batch, or out of 1-5, or below 3 in both, are left out; a failed batch is one row with an error.
    The scorer is called once for each batch, from a stream over sorted partitions."""
    call = with_retry(scorer, wait=wait)
    keys = ["clip_name", "batch_id"]

    def score(pdf: pd.DataFrame) -> list[tuple]:
        clip, batch, t = pdf["clip_name"].iloc[0], pdf["batch_id"].iloc[0], pdf["t"].to_numpy()
        found, error = call(pdf)
        if error is not None:
            return [(clip, batch, None, None, None, None, error)]
        n, visual, action = (found[c].to_numpy() for c in ("frame_index", "visual", "action"))
        ok = (n >= 0) & (n < len(t)) & (visual >= 1) & (visual <= 5) & (action >= 1) & (action <= 5) & ((visual >= 3) | (action >= 3))
        n = n[ok].astype(int)
        return [(clip, batch, *x, None) for x in zip(n.tolist(), t[n].tolist(), visual[ok].tolist(), action[ok].tolist(), strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _tables((score(g) for g in each_group(batches, keys)), [*keys, "frame_index", "t", "visual", "action", "error"], ("frame_index", "visual", "action"))

    rows = dealt(frames.select("clip_name", F.col("t").cast("double").alias("t")), "clip_name")
    numbered = batches(rows, size, ["clip_name"], ["t"]).sortWithinPartitions(*keys, "t")
    return numbered.mapInPandas(run, "clip_name string, batch_id int, frame_index int, t double, visual int, action int, error string")


def hot_windows(scores: DataFrame, clips: DataFrame, forced: DataFrame | None = None, pad: float = 5.0, least: float = 5.0) -> DataFrame:
    """(clip_name, region_start, region_end) around hot frames, then forced times (clip_name, times, in order) and coverage
    samples that aren't near those before them."""
    hot = scores.where("error is null").groupBy("clip_name").agg(F.array_sort(F.collect_list("t")).alias("hot"))
    none = F.array().cast("array<double>")
    rows = clips.select("clip_name", F.col("duration_secs").alias("duration")).join(hot, "clip_name", "left")
    rows = rows.join(forced, "clip_name", "left") if forced is not None else rows.withColumn("times", none)
    times = injected_times(injected_times(F.coalesce("hot", none), F.coalesce("times", none), least), coverage_times(F.col("duration")), least)
    return merge_regions(rows.select("clip_name", "duration", F.explode(times).alias("t")), pad)


def fine_ratings(windows: DataFrame, scorer: Scorer, samples: int = 6, wait: float = 5.0) -> DataFrame:
    """One rubric per window (clip_name, region_start, region_end) from evenly spaced samples, or an error."""
    call = with_retry(scorer, wait=wait)
    dims = ("light", "composition", "motion", "scenery", "subject")
    columns = ["clip_name", "video_start", "video_end", *dims, "peak_offset", "crop_x", "clip_type", "error"]

    def rate(pdf: pd.DataFrame) -> list[tuple]:
        head = (pdf["clip_name"].iloc[0], pdf["region_start"].iloc[0], pdf["region_end"].iloc[0])
        found, error = call(pdf)
        if error is None and (not len(found) or not all(1 <= int(found[d].iloc[0]) <= 10 for d in dims)):
            error = "invalid result"
        if error is not None:
            return [(*head, *[None] * 5, None, None, None, error)]
        r = found.iloc[0]
        offset = min(1.0, max(0.0, float(r.get("peak_offset", 0.5))))
        return [(*head, *[int(r[d]) for d in dims], offset, int(r.get("crop_x", 50)), str(r.get("clip_type", "")), None)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _tables((rate(g) for g in each_group(batches, ["clip_name", "region_start"])), columns, (*dims, "crop_x"))

    t = F.col("region_start") + (F.col("region_end") - F.col("region_start")) * (F.col("i") + num(0.5)) / samples
    rows = dealt(windows, "clip_name", "region_start").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("t", t)
    return rows.sortWithinPartitions("clip_name", "region_start", "t").mapInPandas(run, "clip_name string, video_start double, video_end double, light int, composition int, motion int, scenery int, subject int, peak_offset double, crop_x int, clip_type string, error string")


def tally(results: DataFrame, clips: DataFrame, shown: int = 3) -> DataFrame:
    """(clip_name, n_errors, messages, degraded): hard failures of each clip, the first few messages."""
    failed = results.where("error is not null").groupBy("clip_name").agg(F.count(F.lit(1)).alias("n_errors"), F.slice(F.array_sort(F.collect_set("error")), 1, shown).alias("messages"))
    rows = clips.select("clip_name").distinct().join(failed, "clip_name", "left")
    return rows.select("clip_name", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.coalesce("messages", F.array().cast("array<string>")).alias("messages"), F.col("n_errors").isNotNull().alias("degraded"))


def cacheable(results: DataFrame, tallied: DataFrame) -> DataFrame:
    """Results of clips without a hard failure; only these may be cached."""
    return results.join(tallied.where("n_errors = 0").select("clip_name"), "clip_name", "left_semi")


def valid_frame(frame_index: str = "frame_index", size: int = 50):
    """Whether a frame score's fields lie within their bounds."""
    return F.coalesce(F.col(frame_index).between(0, size - 1) & F.col("visual").between(1, 5) & F.col("action").between(1, 5) & F.coalesce("crop_x", F.lit(50)).between(0, 100), F.lit(False))


# --- replies as text ------------------------------------------------------------------------------------------------

FRAME = "struct<frame_index:int,visual:int,action:int,clip_type:string,crop_x:int,reason:string>"
RUBRIC = "struct<light:int,composition:int,motion:int,scenery:int,subject:int,peak_offset:double,clip_type:string,crop_x:int,reason:string>"


def _at(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _whole(value: Column, path: str, low: int | None = None, high: int | None = None, default: int | None = None) -> tuple[Column, Column]:
    """(value, whether it is a whole number within bounds), with a default where the field is missing or null."""
    given = _at(value, path, "double")
    ok = (given == F.floor(given)) & (F.lit(True) if low is None else given.between(low, high))
    missing = _at(value, path, "variant").isNull() | F.is_variant_null(_at(value, path, "variant"))
    if default is None:
        return given.cast("int"), F.coalesce(ok, F.lit(False))
    return F.when(missing, F.lit(default)).otherwise(given.cast("int")), missing | F.coalesce(ok, F.lit(False))


def _text(value: Column, path: str) -> Column:
    return F.coalesce(_at(value, path, "string"), F.lit(""))


def _reply(text: Column, use: Callable[[Column, Column], Column]) -> Column:
    """`use` of (variant, its kind: ARRAY, OBJECT, another, or null where nothing can be parsed), through `parsed_json`; both are
    worked out once for a row."""
    parsed = bound(json_found(text), lambda r: F.when(r["ok"], F.try_parse_json(r["value"])))
    return bound(parsed, lambda p: bound(F.regexp_extract(F.schema_of_variant(p), "^[A-Z]+", 0), lambda kind: use(p, kind)))


def _listed(parsed: Column, kind: Column, field: str) -> Column:
    """The elements of an array, or of the array that an object holds in `field`; else null."""
    inner = _at(parsed, f"$.{field}", "variant")
    held = F.startswith(F.schema_of_variant(inner), F.lit("ARRAY"))
    return F.when(kind == "ARRAY", _at(parsed, "$", "array<variant>")).when((kind == "OBJECT") & held, _at(parsed, f"$.{field}", "array<variant>"))


def _or_error(items: Column, ok: Column, parsed: Column, kind: Column, what: str) -> Column:
    """struct<value, error>: `items` if they are there and `ok`."""
    error = F.when(parsed.isNull(), "no JSON").when(items.isNull(), F.concat(F.lit(f"no {what} in "), F.lower(kind))).when(~ok, f"invalid {what}")
    return F.struct(F.when(error.isNull(), items).alias("value"), error.alias("error"))


def frames_in(text: Column) -> Column:
    """struct<value: array of `FRAME`, error> of a reply to the coarse pass: an array of frames, or an object that holds one as
    `frames`. One invalid frame (no whole frame_index; visual or action not whole or not in 1-5; crop_x not in 0-100) makes the
    reply an error."""

    def frame(x: Column) -> Column:
        parts = {"frame_index": _whole(x, "$.frame_index"), "visual": _whole(x, "$.visual", 1, 5), "action": _whole(x, "$.action", 1, 5), "crop_x": _whole(x, "$.crop_x", 0, 100, 50)}
        values = {name: value for name, (value, _) in parts.items()} | {c: _text(x, f"$.{c}") for c in ("clip_type", "reason")}
        order = [part.split(":")[0] for part in FRAME.removeprefix("struct<").removesuffix(">").split(",")]
        return F.struct(F.struct(*[values[c].alias(c) for c in order]).alias("frame"), reduce(lambda a, b: a & b, (ok for _, ok in parts.values())).alias("ok"))

    def frames(parsed: Column, kind: Column) -> Column:
        told = F.transform(_listed(parsed, kind, "frames"), frame)
        return bound(told, lambda x: _or_error(F.transform(x, lambda y: y["frame"]), F.forall(x, lambda y: y["ok"]), parsed, kind, "frames"))

    return _reply(text, frames)


def indices_in(text: Column) -> Column:
    """struct<value: array<int>, error> of a reply to the story selection: an array of whole numbers, or an object that holds one
    as `indices`."""
    number = lambda x: F.schema_of_variant(x).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    whole = lambda x: F.coalesce(number(x) & _at(x, "$", "int").isNotNull(), F.lit(False))
    told = lambda items, parsed, kind: _or_error(F.transform(items, lambda x: _at(x, "$", "int")), F.forall(items, whole), parsed, kind, "indices")
    return _reply(text, lambda parsed, kind: bound(_listed(parsed, kind, "indices"), lambda items: told(items, parsed, kind)))


def rubric_in(text: Column) -> Column:
    """struct<value: `RUBRIC`, error> of a reply to the fine pass: an object, or the first of an array of objects; five whole
    numbers in 1-10, and an offset in 0-1, by default the middle."""
    return _reply(text, _rubric)


def _rubric(parsed: Column, kind: Column) -> Column:
    one = F.when(kind == "ARRAY", F.get(_at(parsed, "$", "array<variant>"), F.lit(0))).otherwise(parsed)
    one = F.when(F.startswith(F.schema_of_variant(one), F.lit("OBJECT")), one)
    dims = {c: _whole(one, f"$.{c}", 1, 10) for c in RUBRIC_DIMS} | {"crop_x": _whole(one, "$.crop_x", 0, 100, 50)}
    offset = F.coalesce(_at(one, "$.peak_offset", "double"), num(0.5))
    values = {c: v for c, (v, _) in dims.items()} | {"peak_offset": offset} | {c: _text(one, f"$.{c}") for c in ("clip_type", "reason")}
    order = [part.split(":")[0] for part in RUBRIC.removeprefix("struct<").removesuffix(">").split(",")]
    ok = reduce(lambda a, b: a & b, (ok for _, ok in dims.values())) & offset.between(0, 1)
    return _or_error(F.when(one.isNotNull(), F.struct(*[values[c].alias(c) for c in order])), ok, parsed, kind, "rubric")


def scan(clips: DataFrame, frames: DataFrame, coarse: Scorer, fine: Scorer, cache: DataFrame | None = None, forced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ratings, tally) of clips that the cache (clip_name) lacks: coarse pass, hot windows, fine pass."""
    todo = clips if cache is None else clips.join(cache.select("clip_name").distinct(), "clip_name", "left_anti")
    scores = coarse_scores(frames.join(todo.select("clip_name"), "clip_name", "left_semi"), coarse)
    ratings = fine_ratings(hot_windows(scores, todo, forced), fine)
    return ratings.where("error is null"), tally(scores.select("clip_name", "error").unionByName(ratings.select("clip_name", "error")), todo)
