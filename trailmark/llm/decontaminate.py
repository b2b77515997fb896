"""Operator 8, benchmark decontamination, by Wu-Manber multi-pattern search over words.

The alphabet is words. A pattern is a window of ten consecutive words of a benchmark item; an item of fewer words is one
pattern. For the patterns of one length m, a shift table maps each block of two adjacent words that occurs in a pattern
to the distance from its rightmost occurrence to the pattern's end; any other block lets the search skip m - 1 words at
once. At distance 0, the hash bucket of that suffix block holds the patterns, hashed once more as wholes, so that a window is
compared directly with the one pattern that it can be, however many share a suffix.

Windows are made and reduced to distinct ones in Spark, and dealt by hash into blocks of about `block_words` words, so
that neither copies of items nor a long item make a block larger. Only one block at a time comes through the driver to be
broadcast; a search returns windows, and a shuffled join on the window names its items, so lists of ids stay in
Spark. A benchmark of one block, about 200,000 distinct windows, takes one pass over the documents; each further block
takes another, of which only texts with hits are kept. Each document is searched whole, in its own task, so a hot passage
costs no shuffle. Python gets texts in Arrow batches of at most 64 MB, and a longer text alone.

Nulls: a null text has no words, a null item no patterns; items with a null id are named `null` in item lists. Repeated
items and repeated windows are compared once and all their items are reported. Repeated documents are reported each, a very
long text is searched in one piece, in time linear in its words but for its hits, and an empty table of either
kind gives no hits. Columns of documents travel in a struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, checkpointed, packed, without_keys

WINDOW = 10
#: Words of patterns that one pass holds: about 100 MB in each Python worker.
BLOCK_WORDS = 2_000_000
_FOUND = "n_words long, spans array<long>, windows array<string>"


class Patterns:
    """Shift tables and suffix buckets of one block of patterns, one pair for each pattern length."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]):
        self.tables: dict[int, tuple[dict, dict]] = {}
        for words in patterns:
            m, size = len(words), min(2, len(words))
            shift, bucket = self.tables.setdefault(m, ({}, {}))
            for end in range(size, m + 1):
                block = words[end - size : end]
                shift[block] = min(shift.get(block, m), m - end)
            bucket.setdefault(words[m - size :], set()).add(words)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        for m, (shift, bucket) in self.tables.items():
            size = min(2, m)
            end, last, skip = m, len(words), m - size + 1
            while end <= last:
                block = tuple(words[end - size : end])
                step = shift.get(block, skip)
                if step:
                    end += step
                    continue
                window = tuple(words[end - m : end])
                if window in bucket[block]:
                    yield end - m, window
                end += 1


def windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = alnum_words(text)
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def window_owners(benchmark: DataFrame, id_col: str, text: str) -> DataFrame:
    """(window, item): the distinct windows, as words between blanks, of each item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, t in zip(batch["item"], batch["t"], strict=True):
                found = [b" ".join(w).decode() for w in dict.fromkeys(windows(t))]
                yield pd.DataFrame({"window": found, "item": [item] * len(found)}, dtype="object")

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("t"))
    return rows.mapInPandas(run, "window string, item string").distinct()


def pattern_blocks(owners: DataFrame, block_words: int) -> Iterator[list[str]]:
    """The distinct windows, in blocks of about `block_words` words."""
    wins = checkpointed(owners.select("window").distinct())
    words = wins.agg(F.sum(F.size(F.split("window", " ")))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    for i in range(blocks):
        block = wins.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i)
        yield [r["window"] for r in block.toLocalIterator()]


def merged(starts_ends: list[tuple[int, int]]) -> list[int]:
    """Flat [start, end, ...] of the union of half-open ranges."""
    out: list[int] = []
    for a, b in sorted(starts_ends):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def searched(docs: DataFrame, text: str, block: list[str]) -> Column:
    """For each row the struct of `_FOUND`: hits of one block's windows."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        patterns = Patterns(tuple(w.encode().split(b" ")) for w in shared.value)
        for texts in batches:
            out = []
            for t in texts:
                words = alnum_words(t)
                hits = list(patterns.search(words))
                found = {b" ".join(p).decode() for _, p in hits}
                out.append((len(words), merged([(a, a + len(p)) for a, p in hits]), sorted(found)))
            yield pd.DataFrame(out, columns=["n_words", "spans", "windows"])

    return search(text)


@F.pandas_udf(T.ArrayType(T.LongType()))
def united(spans: pd.Series) -> pd.Series:
    """The union of the ranges of flat [start, end, ...] lists."""
    return pd.Series([merged(list(zip(x[::2], x[1::2], strict=True))) for x in spans])


def _text_key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` packed as struct `row`, with `n_words`, `spans` (flat [start, end, ...] of hit word ranges, merged) and
    `items` (ids, as strings, of the items with an occurring window, sorted as strings). Rows are checkpointed once."""
    return _found(docs, docs.columns, benchmark, text, item_id, item_text, block_words)


def _found(docs: DataFrame, keep: list[str], benchmark: DataFrame, text: str, item_id: str, item_text: str, block_words: int) -> DataFrame:
    owners = checkpointed(window_owners(benchmark, item_id, item_text))
    state, more = None, []
    for block in pattern_blocks(owners, block_words):
        if state is None:
            whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), _text_key(text).alias("key"), F.col(text).alias("bd_text"))
            state = checkpointed(whole.select("row", "key", searched(docs, "bd_text", block).alias("f")).select("row", "key", "f.*"))
        else:
            rest = docs.select(_text_key(text).alias("key"), F.col(text).alias("bd_text"))
            hits = rest.select("key", searched(docs, "bd_text", block).alias("f")).where(F.size("f.spans") > 0)
            more.append(checkpointed(hits.select("key", F.col("f.spans").alias("spans"), F.col("f.windows").alias("windows")).dropDuplicates(["key"])))
    hit = state.where(F.size("spans") > 0).select("key", "spans", "windows").dropDuplicates(["key"])
    for x in more:
        hit = hit.unionByName(x)
    if more:  # a text has at most one row of each block
        hit = hit.groupBy("key").agg(united(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("windows")).alias("windows"))
    hit = checkpointed(hit)
    named = hit.select("key", F.explode("windows").alias("window")).join(owners, "window").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = checkpointed(hit.select("key", "spans").join(named, "key"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    hits = state.select("row", "key", "n_words").join(named, "key", "left")
    return hits.select("row", "n_words", F.coalesce("spans", none("long")).alias("spans"), F.coalesce("items", none("string")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The digest of `find_benchmark`: one row per document."""
    found = _found(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], benchmark, "text", "item_id", "text", block_words)
    at = F.expr("transform(spans, (x, i) -> if(i % 2 = 0, -x, x))")
    n_hit = F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` without the documents in which a benchmark window occurs."""
    whole, gone = packed(docs, key=_text_key(text), bd_text=F.col(text)), []
    blocks = pattern_blocks(checkpointed(window_owners(benchmark, "item_id", "text")), block_words)
    first = next(blocks)
    for block in blocks:
        hits = whole.select("key", searched(docs, "bd_text", block).alias("f")).where(F.size("f.spans") > 0)
        gone.append(checkpointed(hits.select("key").distinct()))
    clean = whole.where(F.size(searched(docs, "bd_text", first)["spans"]) == 0)
    for keys in gone:
        clean = without_keys(clean, "key", keys)
    return clean.select("row.*")
