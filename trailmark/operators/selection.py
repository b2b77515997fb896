"""Selection of a spread-out subset, and the cut list.

The greedy steps are sequential in their own picks, so each (entity, layout) is taken as a whole, which the cap on
candidates keeps small; entities and layouts run in parallel. What a pick changes is kept in arrays, so a pick costs one pass
over the pool.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import anchored_cut, num

# Floor between picks, weight and limit of crowding, weight of scores when filling, gaps.
FLOOR_SECS, CROWD_WEIGHT, CROWD_LIMIT, FILL_WEIGHT = 3.0, 6.0, 2.0, 30.0
WIDE_GAP, EDGE_PAD = 180.0, 30.0


def slots(budget: Column, slot_secs: float = 3.0) -> Column:
    return F.greatest(F.lit(1), F.floor(budget / slot_secs).cast("int"))


def decay(rows: DataFrame, n: Column, key: str = "ride_id", t: str = "t") -> DataFrame:
    """(key, tau): seconds over which crowding fades: the span over the slots, 60 at least."""
    return rows.groupBy(key).agg((F.max(t) - F.min(t)).alias("span")).select(key, F.greatest(num(60), F.coalesce("span", num(0)) / n).alias("tau"))


def crowding(rows: DataFrame, picks: DataFrame, tau: float, key: str = "ride_id", t: str = "t", limit: float = CROWD_LIMIT) -> DataFrame:
    """`rows` with `crowding`: sum of exp(-gap / tau) to the entity's picks, up to the limit. Picks are a few per entity."""
    p = picks.select(key, F.col(t).alias("p_t")).groupBy(key).agg(F.collect_list("p_t").alias("picked"))
    total = F.aggregate(F.coalesce("picked", F.array().cast("array<double>")), num(0), lambda a, x: a + F.exp(-F.abs(F.col(t) - x) / tau))
    return rows.join(p, key, "left").withColumn("crowding", F.least(total, num(limit))).drop("picked")


def absorbed(ranked: DataFrame, pool: DataFrame, n: int, key: str = "ride_id", t: str = "t", seq: str = "seq") -> DataFrame:
    """(key, seq, rank0): the pool rows at a model's ranked positions, counted in time order: positions out of range and
    repeats go, at most n stay, and a list that gives less than half of n gives nothing."""
    placed = pool.select(key, seq, (F.row_number().over(Window.partitionBy(key).orderBy(t, seq)) - 1).alias("position"))
    listed = ranked.select(key, F.posexplode("positions").alias("at", "raw")).withColumn("position", F.col("raw").try_cast("int"))
    first = listed.where("position is not null").groupBy(key, "position").agg(F.min("at").alias("at"))
    found = first.join(placed, [key, "position"])
    found = found.withColumn("rank0", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("rank0") <= n)
    return found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))).where(F.col("n") * 2 >= n).select(key, seq, "rank0")


class Crowd:
    """A pool (a list of items in time order) as arrays that each pick updates: decayed crowding, distance to the nearest pick,
    and which items may still be taken."""

    def __init__(self, pool: list[dict], tau: float):
        self.pool, self.tau = pool, tau
        self.t = np.array([c["t"] for c in pool], np.float64)
        self.score = np.array([c["score"] for c in pool], np.float64)
        self.value = np.array([c["score"] + c["boost"] for c in pool], np.float64)
        self.crowding, self.nearest = np.zeros(len(pool)), np.full(len(pool), 1e9)
        self.used = np.zeros(len(pool), bool)
        self.picks: list[int] = []

    def pick(self, i: int) -> None:
        away = np.abs(self.t - self.t[i])
        self.crowding += np.exp(-away / self.tau)
        self.nearest = np.minimum(self.nearest, away)
        self.used[i] = True
        self.picks.append(i)

    def worth(self) -> np.ndarray:
        """Score and boost less crowding."""
        return self.value - CROWD_WEIGHT * np.minimum(self.crowding, CROWD_LIMIT)

    def best(self, by: np.ndarray) -> int | None:
        """The first of the greatest by `by` that is free and keeps the floor."""
        free = ~self.used & (self.nearest >= FLOOR_SECS)
        return int(np.argmax(np.where(free, by, -np.inf))) if free.any() else None

    def taken(self, n: int) -> list[dict]:
        """The first n picks, in time order."""
        return [self.pool[i] for i in sorted(self.picks, key=lambda i: self.t[i])][:n]


def _backfill(crowd: Crowd, n: int) -> None:
    """For the widest gap between picks that has an item well inside, its best one, again and again until n."""
    while 2 <= len(crowd.picks) < n:
        order = sorted(crowd.picks, key=lambda i: crowd.t[i])
        best = None
        for a, b in itertools.pairwise(crowd.t[order]):
            if b - a > WIDE_GAP and (best is None or b - a > best[0]):
                inside = ~crowd.used & (crowd.t >= a + EDGE_PAD) & (crowd.t <= b - EDGE_PAD)
                if inside.any():
                    best = (b - a, int(np.argmax(np.where(inside, crowd.score, -np.inf))))
        if best is None:
            return
        crowd.pick(best[1])


def backfilled(picks: list[dict], pool: list[dict], n: int) -> list[dict]:
    """`picks`, all of `pool`, with gaps filled up to n."""
    crowd = Crowd(pool, 60.0)
    places = {c["seq"]: i for i, c in enumerate(pool)}
    for p in picks:
        crowd.pick(places[p["seq"]])
    _backfill(crowd, n)
    return [pool[i] for i in crowd.picks]


def chosen(pool: list[dict], n: int, tau: float, ranked: bool = False) -> list[dict]:
    """The selection of one group: must-includes; ranked picks that don't crowd, with gaps backfilled; then greedily the
    best of score, boost and crowding; then whatever fills up to n with most distance. In time order, the first n."""
    crowd = Crowd(pool, tau)
    for i, c in enumerate(pool):
        if c["must_include"]:
            crowd.pick(i)
    if ranked and any(c["rank0"] > 0 for c in pool):
        for i in sorted((i for i, c in enumerate(pool) if c["rank0"] > 0), key=lambda i: -crowd.value[i]):
            if not crowd.used[i] and crowd.nearest[i] >= FLOOR_SECS and crowd.worth()[i] >= 0:
                crowd.pick(i)
        _backfill(crowd, n)
        if len(crowd.picks) >= n:
            return crowd.taken(n)
    while len(crowd.picks) < n:
        worth = crowd.worth()
        best = crowd.best(worth)
        if best is None or worth[best] < 0:
            break
        crowd.pick(best)
    while len(crowd.picks) < n:
        best = crowd.best(crowd.nearest + FILL_WEIGHT * crowd.score)
        if best is None:
            break
        crowd.pick(best)
    return crowd.taken(n)


def selected(pool: DataFrame, n: int, ranked: bool = False, key: str = "ride_id", layout: str | None = None) -> DataFrame:
    """(key, [layout,] seq, t, score, place): the selection of n of each (entity, layout), in time order. Pools are streamed
    from sorted partitions, one held at a time; the cap on candidates bounds each."""
    extra = {"boost": num(0), "rank0": F.lit(0), "must_include": F.lit(False)}
    group = [key] + ([layout] if layout else [])
    rows = pool.select(*group, F.col("seq").cast("long").alias("seq"), F.col("t").cast("double").alias("t"), F.col("score").cast("double").alias("score"), *[(F.coalesce(F.col(c), v) if c in pool.columns else v).alias(c) for c, v in extra.items()])
    fields = [c for c in rows.columns if c not in group]
    schema = T.StructType([*[rows.schema[g] for g in group], *T.StructType.fromDDL("seq long, t double, score double, place int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items, out, types = None, [], [], []

        def close() -> None:
            if items:
                tau = max(60.0, (items[-1]["t"] - items[0]["t"]) / n)
                out.extend((*at, p["seq"], p["t"], p["score"], i) for i, p in enumerate(chosen(items, n, tau, ranked), 1))
                items.clear()

        def told() -> pa.RecordBatch:
            kinds = [*types, pa.int64(), pa.float64(), pa.float64(), pa.int32()]
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
            out.clear()
            return done

        for batch in batches:
            types = [batch.column(g).type for g in group]
            values = [batch.column(c).to_pylist() for c in fields]
            for i, found in enumerate(zip(*(batch.column(g).to_pylist() for g in group), strict=True)):
                if found != at:
                    close()
                    at = found
                items.append({c: v[i] for c, v in zip(fields, values, strict=True)})
            if out:
                yield told()
        close()
        if out:
            yield told()

    return rows.repartition(*group).sortWithinPartitions(*group, "t", "seq").mapInArrow(run, schema)


def selection_overlap(pool: DataFrame, n: int, key: str = "ride_id") -> DataFrame:
    """(key, n_greedy, n_ranked, n_both): greedy selection against the one that starts from ranked picks."""
    a, b = selected(pool, n, False, key), selected(pool, n, True, key)
    both = a.select(key, "seq", F.lit(1).alias("g")).join(b.select(key, "seq", F.lit(1).alias("r")), [key, "seq"], "full")
    return both.groupBy(key).agg(F.count("g").alias("n_greedy"), F.count("r").alias("n_ranked"), F.count_if(F.col("g").isNotNull() & F.col("r").isNotNull()).alias("n_both"))


def cut_list(moments: DataFrame, trim: float = 3.0, lead: float = 2.0, intro: float = 0.0, key: str = "ride_id", t: str = "t", seq: str = "seq") -> DataFrame:
    """`moments` with slot, cut_start and cut_secs: each moment's own trim or the default, the last with a lead for the
    fade, the first with a minimum for the title; a trim of 0 takes the whole span."""
    up, down = Window.partitionBy(key).orderBy(t, seq), Window.partitionBy(key).orderBy(F.desc(t), F.desc(seq))
    own = F.when(F.coalesce("final_trim_secs", num(0)) != 0, F.col("final_trim_secs")).otherwise(num(trim))
    rows = moments.withColumn("slot", F.row_number().over(up)).withColumn("last_slot", F.row_number().over(down) == 1)
    rows = rows.withColumn("active", own + F.when(F.col("last_slot") & (own > 0), num(lead)).otherwise(num(0)))
    floor = F.when(F.col("slot") == 1, num(intro)).otherwise(num(0))
    anchor = F.coalesce("anchor", (F.col("video_start") + F.col("video_end")) / 2)
    start, secs = anchored_cut(F.col("video_start"), F.col("video_end"), anchor, F.col("active"), floor)
    whole = F.greatest(F.col("video_end") - F.col("video_start"), floor)
    return rows.withColumn("cut_start", F.when(F.col("active") > 0, start).otherwise(F.col("video_start"))).withColumn("cut_secs", F.when(F.col("active") > 0, secs).otherwise(whole)).drop("last_slot", "active")
