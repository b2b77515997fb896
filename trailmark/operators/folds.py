"""Order-dependent folds of a time series that run as streams over sorted partitions.

An entity's rows are cut into runs where a gap is so wide that the fold can't reach across it. Blocks of runs are dealt to
partitions, sorted, and read as a stream: the state of the open run is carried from batch to batch and ends with the
run. So neither a run nor an entity is a group of its own, many short runs cost no more than their rows, and a long entity is
spread over partitions wherever it has gaps. Memory is bounded by a batch and by what lies within a window of the time reached.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs of an entity that are dealt to one partition together.
RUNS = 256


def dealt_in_runs(rows: DataFrame, key: str, t: str, apart: Column, order: list[str]) -> DataFrame:
    """`rows` with `run`, dealt by (key, block of runs) and sorted by key, run and `order`. A run starts where `apart` holds of
    `t` and `before`, the time of the entity's row before."""
    by_time = Window.partitionBy(key).orderBy(t)
    marked = rows.withColumn("before", F.lag(t).over(by_time)).withColumn("cut", F.coalesce(apart.cast("long"), F.lit(0)))
    marked = marked.withColumn("run", F.sum("cut").over(by_time)).drop("before", "cut")
    return marked.repartition(key, F.floor(F.col("run") / RUNS)).sortWithinPartitions(key, "run", *order)


class Matcher:
    """Labels in time order each take the closest free hit within the window, the earlier on ties. Rows come in time order."""

    def __init__(self, window: float):
        self.window, self.waiting = window, deque()
        self.times, self.ids = [], []  # free hits, in time order

    def add(self, t: float | None, row_id, is_label: bool) -> Iterator[tuple]:
        """(label_id, hit_id, outcome) of what is settled once the row is there."""
        if t is None or t != t:
            yield (row_id, None, "label_only") if is_label else (None, row_id, "model_only")
            return
        while self.waiting and self.waiting[0][0] + self.window < t:
            yield from self._settle()
        if is_label:
            self.waiting.append((t, row_id))
        else:
            if not self.waiting:
                yield from self._expire(t - self.window)
            self.times.append(t)
            self.ids.append(row_id)

    def end(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._settle()
        yield from ((None, i, "model_only") for i in self.ids)
        self.times, self.ids = [], []

    def _expire(self, before: float) -> Iterator[tuple]:
        """Hits that no later label reaches."""
        n = bisect_left(self.times, before)
        if n:
            yield from ((None, i, "model_only") for i in self.ids[:n])
            del self.times[:n], self.ids[:n]

    def _settle(self) -> Iterator[tuple]:
        at, label = self.waiting.popleft()
        yield from self._expire(at - self.window)
        i, best = bisect_left(self.times, at), None
        if i < len(self.times) and self.times[i] <= at + self.window:
            best = i
        if i and (best is None or at - self.times[i - 1] <= self.times[i] - at):
            best = bisect_left(self.times, self.times[i - 1])  # the first of that time
        if best is None:
            yield label, None, "label_only"
        else:
            yield label, self.ids[best], "matched"
            del self.times[best], self.ids[best]


class Fusion:
    """Items in time order, each of which meets the first entry, in order of appearance, that either has another source and is
    closer than a window (wider if a label is involved), or is of its own vision source and closer than that source's window. It
    merges into that entry in place, by `join` or `keep`, else it is a new entry.

    An entry's time is that of one of its items, so it only falls behind. For each source, label involved or not, and kind of
    window, a heap holds the entries' numbers; those that fall out of a window leave that heap for good, or until they
    get a new time. So an item costs a few looks at heaps, however many entries lie within a window."""

    def __init__(self, merge: float, label: float, vision: float, vision_sources, join, keep):
        self.widths = {"merge": merge, "label": label, "vision": vision}
        self.vision_sources, self.join, self.keep = frozenset(vision_sources), join, keep
        self.entries: dict[int, dict] = {}
        self.heaps: dict[tuple[str, bool], dict[str, list[int]]] = {}
        self.next, self.swept = 0, 0

    @staticmethod
    def _group(entry: dict) -> tuple[str, bool]:
        return entry["source"], "label" in entry["sources"]

    def _put(self, number: int, entry: dict) -> None:
        self.entries[number] = entry
        for heap in self.heaps.setdefault(self._group(entry), {k: [] for k in self.widths}).values():
            heapq.heappush(heap, number)

    def _first(self, group: tuple[str, bool], kind: str, t: float) -> int | None:
        heap, width = self.heaps[group][kind], self.widths[kind]
        while heap:
            entry = self.entries.get(heap[0])
            if entry is not None and self._group(entry) == group and t - entry["t"] < width:
                return heap[0]
            heapq.heappop(heap)
        return None

    def add(self, item: dict) -> None:
        t, source, labelled = item["t"], item["source"], "label" in item["sources"]
        found = None
        if t is not None and t == t:
            for group in self.heaps:
                if group[0] != source:
                    number = self._first(group, "label" if labelled or group[1] else "merge", t)
                elif source in self.vision_sources:
                    number = self._first(group, "vision", t)
                else:
                    continue
                if number is not None and (found is None or number < found):
                    found = number
        if found is None:
            self.entries[self.next] = item
            if t is not None and t == t:
                self._put(self.next, item)
            self.next += 1
        else:
            entry = self.entries[found]
            self._put(found, self.join(entry, item) if entry["source"] != source else self.keep(entry, item))

    def behind(self, t: float) -> list[dict]:
        """Entries that no item from time `t` on can meet, taken out; looked for each time that their number has doubled."""
        if len(self.entries) < 2 * self.swept + 1024:
            return []
        widest = max(self.widths.values())
        gone = [n for n, e in self.entries.items() if not t - (e["t"] if e["t"] is not None else t) < widest]
        out = [self.entries.pop(n) for n in gone]
        self.swept = len(self.entries)
        return out

    def end(self) -> list[dict]:
        """All entries, in order of appearance."""
        out = [self.entries[n] for n in sorted(self.entries)]
        self.entries, self.heaps, self.next, self.swept = {}, {}, 0, 0
        return out


def spaced(ranked: list[tuple[float, int]], taken: list[float], gap: float, n: int) -> list[int]:
    """Places of the first n of `ranked` (time, place) that are `gap` apart from all times taken and from each other. Times are
    kept sorted, so only two neighbours are looked at."""
    times, out = sorted(taken), []
    for t, place in ranked:
        if len(out) >= n:
            break
        i = bisect_left(times, t)
        if (i == 0 or t - times[i - 1] >= gap) and (i == len(times) or times[i] - t >= gap):
            insort(times, t)
            out.append(place)
    return out
