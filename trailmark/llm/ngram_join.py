"""Operator 7, n-gram Jaccard join, by a token-group matrix.

A document is the set of its distinct k-word shingles, as 64-bit hashes ("tokens"). Two documents link when their
Jaccard similarity reaches the threshold; components are the transitive closure. The search is exact.

1. Equal sets are one node, so copies cost nothing further. Each row is a document of its own; its id only names things.
2. Tokens have one global order: those whose hash falls in a fixed share of the hash space first, within them by document
   frequency. Two linked sets share a token within their first n - ceil(t n) + 1 tokens in any order (prefix filter). A
   set's prefix nearly always lies in that share, its pool; only pools are shuffled and counted. A set whose pool doesn't
   reach takes all its tokens. Tokens that no other pool holds come first and link nothing, so they are dropped: a
   document of mostly its own wording leaves the join here, and work stays in proportion to what is really shared.
3. Partition: each set follows the leader of its size band with which its prefix shares most, a set with fewer tokens of its
   own; what follows one root is a family of similar sets, whose most central set becomes its root; families are split into
   groups of about `GROUP`.
4. Within a family every set is held as its difference from the root: tokens it adds and tokens it lacks. Two sets differ by
   exactly as many tokens as their differences do, and a set too far from the root to be linked to it can only be linked to
   sets that share about half of their difference with it. So a family of thousands of edited copies costs joins on the
   edits that several of them share, not on the text that all share.
5. Matrix: for each (token, group) the least position and the size range of the members whose prefix holds the token; for
   each group the union of its members' tokens. A set queries the groups of other families. The shared prefix tokens,
   counted in the matrix, bound its overlap with every member; then its overlap with the group's token union does; only
   qualifying groups are opened, and their members compared exactly.
6. Links are closed to components by alternating large-star and small-star steps.

Nothing that grows with the corpus reaches the driver. Counts combine before they are shuffled. Joins on a token or component
may meet a hot one: what was counted by it is checkpointed before it is joined back, so that both sides are shuffled for the
join alone and Spark splits the skewed partitions.

Nulls: null, empty and blank texts have an empty set, link with nothing and are components of their own. A row with a
null id is compared like any other and named by its component; alone, or among null ids only, its component is null.
Repeated rows share their component. Of rows with one id and different texts, each is in the component of its text. A
very long text is one row of 64-bit tokens, a bounded multiple of its own size. Ids are of any type with an order. An
empty table gives an empty result. Input columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rounds, checkpointed, has_rows, likely_keys, packed, release, space_words, without_keys

POOL = 1.6  # share of the tokens in pools, in prefix lengths
GROUP = 64
GROUP_TOKENS = 1_000_000
#: Links that one task joins; more go through rounds.
FEW_LINKS = 200_000
SIGN = 1 << 63
#: Odd multipliers of a hash (fixed values).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class WordHash(dict):
    """Word to 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | bytes | None, hashes: WordHash) -> np.ndarray:
    words = space_words(text)
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k-word shingle of the words `h`; with fewer words, one for the whole sequence; none for none."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    x = np.full(n, 0 if len(h) >= k else len(h), np.uint64)
    for i in range(min(k, len(h))):
        x += (h[i : i + n] ^ (h[i : i + n] >> np.uint64(31))) * MIX[i % 8]
        x ^= x >> np.uint64(29)
        x *= MIX[(i + 3) % 8]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | bytes | None, k: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    return np.unique(shingle_hashes(word_hashes(text, hashes), k))


def set_hash(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed halves of the 128-bit hash of a sorted set."""
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


# --- passes over the texts ----------------------------------------------------------------------------------------


def pool_limit(percent: int) -> int:
    """The unsigned hash below which tokens come first in the order."""
    return min(SIGN * 2 - 1, int(POOL * (100 - percent) / 100 * SIGN * 2))


def prefix_length(n, percent: int):
    """Tokens of a set of n of which a linked set holds one, in any global order."""
    return n - -(-percent * n // 100) + 1


def row_key(id_col: str, text: str) -> Column:
    """A hash of id and text, by which a later pass finds the row again."""
    known = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return F.md5(F.concat(known, F.lit("\x00"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, key, text) of every row."""
    return docs.select(F.col(id_col).alias("id"), row_key(id_col, text).alias("key"), F.col(text).cast("binary").alias("text"))


def fingerprints(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, key, n, two halves of the set's hash, n_first, pool) of keyed `docs`. n_first: tokens in the pools' share;
    pool: those, or all tokens if a prefix needs more. Pool tokens have their top bit flipped, so that signed order is theirs."""
    limit = np.uint64(pool_limit(percent))
    schema = T.StructType([docs.schema["id"], docs.schema["key"]] + [T.StructField(c, T.LongType()) for c in ("n", "hi", "lo", "n_first")] + [T.StructField("pool", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            if not batch.num_rows:
                continue
            pools, facts = [np.empty(0, np.uint64)], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k, hashes)
                n, first = len(s), int(np.searchsorted(s, limit))
                pools.append(s[:first] if first >= prefix_length(n, percent) else s)
                facts.append((n, *(set_hash(s) if n else (0, 0)), first))
            ends = np.cumsum([len(p) for p in pools]).astype(np.int32)
            values = (np.concatenate(pools) ^ np.uint64(SIGN)).view(np.int64)
            pool = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            columns = [pa.array(x, pa.int64()) for x in zip(*facts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *columns, pool], names=schema.names)

    return docs.mapInArrow(run, schema)


def token_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, tokens) of `nodes` (node, key, hi, lo), from the keyed `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            sets = [shingle_set(t.as_py(), k, hashes) for t in batch.column("text")]
            halves = [set_hash(s) for s in sets]
            columns = [pa.array([h[i] for h in halves], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in sets], pa.binary())], names=["hi", "lo", "tokens"])

    found = likely_keys(docs.select("key", "text"), "key", nodes.select("key")).mapInArrow(run, "hi long, lo long, tokens binary")
    found = found.groupBy("hi", "lo").agg(F.first("tokens").alias("tokens"))  # repeated rows have the same
    return nodes.select("node", "hi", "lo").join(found, ["hi", "lo"]).select("node", "tokens")


# --- bounds -------------------------------------------------------------------------------------------------------


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / b)


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Tokens that sets of sizes a and b share if they are linked."""
    return _ceil_div(percent * (a + b), 100 + percent)


def least_shared(a: Column, b: Column, percent: int) -> Column:
    """Tokens that the prefixes of linked sets of sizes a and b share: of two sets, the one whose prefix ends first in the
    order has in the other's prefix all that it shares up to there, and at most ceil(t n) - 1 tokens come after."""
    return least_overlap(a, b, percent) - F.greatest(_ceil_div(percent * a, 100), _ceil_div(percent * b, 100)) + 1


def prefix_length_of(n: Column, percent: int) -> Column:
    """`prefix_length` of a column of sizes."""
    return n - _ceil_div(percent * n, 100) + 1


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def linkable(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union."""
    return 100 * overlap >= percent * (a + b - overlap)


def _rows(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column]


@F.pandas_udf(T.LongType())
def token_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted token sets."""
    found = []
    for x, y in zip(_rows(a), _rows(b), strict=True):
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        at = np.searchsorted(large, small)
        found.append(int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0)
    return pd.Series(found, dtype="int64")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among pairs (a, b, n_a, n_b), by exact comparison."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("tokens").alias(f"t_{s}"))
    joined = pairs.select("a", "b", "n_a", "n_b").join(side("a"), "a").join(side("b"), "b")
    same = joined.withColumn("same", token_overlap("t_a", "t_b"))
    return same.where(linkable(F.col("same"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


# --- components ---------------------------------------------------------------------------------------------------


def roots(links: DataFrame) -> DataFrame:
    """(node, root) from links (a, b) without cycles, of which each a has one: the b's of b's by pointer jumping. Roots are
    their own."""
    rounds = Rounds(links.sparkSession)
    at = rounds.put("at", links.select(F.col("a").alias("node"), F.col("b").alias("root")))
    while True:
        above = at.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = at.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        jumped = rounds.put("at", jumped)
        at = jumped.select("node", "root")
        if not has_rows(jumped.where("moved")):
            rounds.close("at")
            return at.unionByName(at.select(F.col("root").alias("node"), "root").distinct())


def spanning(links: DataFrame) -> DataFrame:
    """Of links (a, b) those that join different trees within their partition: as many as it has nodes at most, and the same
    components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for batch in batches:
            kept = []
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    above[max(x, y)] = min(x, y)
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return links.mapInPandas(run, "a long, b long")


def _joined_here(links: DataFrame) -> DataFrame:
    """(node, comp) of links (a, b) in one partition: the smallest node that each reaches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = above[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
        nodes = list(above)
        yield pd.DataFrame({"node": nodes, "comp": [top(x) for x in nodes]}, dtype="int64")

    return links.mapInPandas(run, "node long, comp long")


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, comp): the smallest node that each linked node reaches.

    Links are first reduced to those that join trees of their partition. Up to `few` that are left are joined in one task,
    whose memory that number bounds; more go through rounds of large and small stars, each between written tables.
    """
    rounds = Rounds(links.sparkSession)
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = rounds.put("edges", spanning(ends))
    if edges.count() <= few:
        return _joined_here(edges.coalesce(1))
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = rounds.put("least", both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = rounds.put("large", large)
        least = rounds.put("least", large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = rounds.put("edges", small)
        row = edges.agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["k"], row["h"]) == mark:
            rounds.close("edges")
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        mark = (row["k"], row["h"])


# --- the join -----------------------------------------------------------------------------------------------------


def prefix_rows(nodes: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, pos, alone), from pools (node, pool) and facts (node, n, n_first): the tokens of each node's prefix that
    other pools hold too, with their place in it. alone: how many in a thousand of its pool's tokens no other pool holds."""
    limit = F.lit(pool_limit(percent) - SIGN)
    rows = nodes.select("node", F.explode("pool").alias("token"))
    often = checkpointed(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = rows.join(often, "token").select("node", F.struct((F.col("token") >= limit).alias("rest"), "df", "token").alias("x"))
    # A document's own shared tokens, in the global order; their number is bounded by the document.
    own = shared.groupBy("node").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    own = own.join(facts.select("node", "n", "n_first"), "node").withColumn("p", F.col("n") - _ceil_div(percent * F.col("n"), 100) + 1)
    first = F.size(F.filter("xs", lambda x: ~x["rest"]))
    own = own.withColumns({"s_first": first, "s_rest": F.size("xs") - first})
    # Tokens that no other pool holds stand before these in each part of the order.
    alone_first, alone_rest = F.col("n_first") - F.col("s_first"), F.col("n") - F.col("n_first") - F.col("s_rest")
    take_first = F.least(F.greatest(F.least("p", "n_first") - alone_first, F.lit(0)), F.col("s_first"))
    take_rest = F.when(F.col("n_first") < F.col("p"), F.least(F.greatest(F.col("p") - F.col("n_first") - alone_rest, F.lit(0)), F.col("s_rest"))).otherwise(0)
    part = lambda start, length, before: F.transform(F.slice("xs", start, length.cast("int")), lambda x, i: F.struct(x["token"].alias("token"), (before + i).cast("int").alias("pos")))
    places = F.concat(part(F.lit(1), take_first, alone_first), part(F.col("s_first") + 1, take_rest, F.col("n_first") + alone_rest))
    alone = F.floor(1000 * alone_first / F.greatest("n_first", F.lit(1))).cast("int").alias("alone")
    return own.select("node", "n", alone, F.explode(places).alias("x")).select("x.token", "node", "n", "x.pos", "alone")


def leaders(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): to each set the leader with which its prefix shares most, a third of it at least. A leader has a smaller share of
    tokens of its own, or that and a smaller number."""
    rank = F.struct("alone", "node", "n")
    rows = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent))))
    lead = checkpointed(rows.groupBy("token", "band").agg(F.min(rank).alias("lead")))
    lead = lead.select("token", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"), "lead")
    tried = rows.join(lead, ["token", "band"]).where((F.col("lead") < rank) & sizes_fit(F.col("n"), F.col("lead.n"), percent))
    pairs = tried.groupBy("node", "n", F.col("lead.node").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    prefix = F.col("n") - _ceil_div(percent * F.col("n"), 100) + 1
    best = pairs.where(3 * F.col("c") >= prefix).groupBy("node").agg(F.max(F.struct("c", -F.col("b"))).alias("x"))
    return best.select(F.col("node").alias("a"), (-F.col("x.col2")).alias("b"))


def centred(fams: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """`fams` (node, root) with each family's root moved to its most central set: the one whose prefix's tokens (`rows`) most
    members hold, on average over the prefix; the smallest number on ties. Sets that differ from a common origin by edits of
    their own are each nearer to it than to each other, so the set nearest to it links with all that link with any, and few
    pairs of sets that aren't linked to the root are left to compare. Any root gives the same links."""
    held = checkpointed(rows.join(fams, "node").select("root", "token", "node", "n"))
    often = held.groupBy("root", "token").agg(F.count(F.lit(1)).alias("df"))
    scored = held.join(checkpointed(often), ["root", "token"]).groupBy("root", "node").agg((F.sum("df") / prefix_length_of(F.first("n"), percent)).alias("share"))
    best = scored.groupBy("root").agg(F.max(F.struct("share", -F.col("node"))).alias("x")).select("root", (-F.col("x.col2")).alias("centre"))
    return fams.join(best, "root", "left").select("node", F.coalesce("centre", "root").alias("root"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def difference(tokens: pd.Series, root: pd.Series) -> pd.Series:
    """Tokens that a sorted set adds to the root's, and those that it lacks, the latter marked by a change of bits."""
    found = []
    for x, y in zip(_rows(tokens), _rows(root), strict=True):
        added = np.setdiff1d(x, y, assume_unique=True)
        lacking = np.setdiff1d(y, x, assume_unique=True) ^ MIX[0]
        found.append(np.sort(np.concatenate([added, lacking]).view(np.int64)))
    return pd.Series(found, dtype="object")


@F.pandas_udf(T.LongType())
def differing(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the symmetric difference of two differences from one root."""
    return pd.Series([len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def most_differing(a: Column, b: Column, percent: int) -> Column:
    """Tokens by which linked sets of sizes a and b differ at most."""
    return a + b - 2 * least_overlap(a, b, percent)


def differences(fams: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root, n, d, near, delta) of the sets of families other than their roots: d tokens of difference from the root;
    near: whether they are linked to it."""
    size = lambda name, n: facts.select(F.col("node").alias(name), F.col("n").alias(n))
    tokens = lambda name, t: sets.select(F.col("node").alias(name), F.col("tokens").alias(t))
    own = fams.where("node <> root").join(size("node", "n"), "node").join(size("root", "n_root"), "root")
    both = own.join(tokens("node", "own"), "node").join(tokens("root", "of_root"), "root")
    told = both.select("node", "root", "n", "n_root", difference("own", "of_root").alias("delta")).withColumn("d", F.size("delta").cast("long"))
    return told.select("node", "root", "n", "d", (F.col("d") <= most_differing(F.col("n"), F.col("n_root"), percent)).alias("near"), "delta")


def family_links(deltas: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within families between sets of which one at least isn't linked to the root.

    For such a set i and any j of its family, d_i > h (n_i + n_root) with h = (100 - t) / (100 + t), and n_j <= n_root + d_j.
    They differ by h (n_i + n_j) at most, so they share more than d_j (1 - h) / 2 = d_j t / (100 + t) of their differences.
    Hence one of the first d_j - floor(d_j t / (100 + t)) of j's in any order ("short" prefix), and, as j's difference is at
    least d_i less what they may differ by, one of i's first (100 - t) n_i / t + 1 ("long"). The first that they share must leave
    both enough for what this pair has to share, (d_i + d_j - what they may differ by) / 2.
    """
    t = percent
    rows = deltas.select("root", "node", F.explode("delta").alias("token"))
    often = checkpointed(rows.groupBy("root", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    own = rows.join(often, ["root", "token"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("xs"))
    own = own.join(deltas.select("node", "root", "n", "d", "near"), "node").withColumn("alone", F.col("d") - F.size("xs"))
    short = F.col("d") - F.floor(F.col("d") * t / (100 + t))
    reach = F.when(F.col("near"), short).otherwise(F.greatest(short, F.floor(F.col("n") * (100 - t) / t) + 1))
    taken = F.slice("xs", 1, F.greatest(F.lit(0), reach - F.col("alone")).cast("int"))
    placed = F.explode(F.transform(taken, lambda x, i: F.struct(x["token"].alias("token"), (F.col("alone") + i).alias("pos"))))
    rows = checkpointed(own.select("node", "root", "n", "d", "near", placed.alias("x")).select("root", "x.token", "x.pos", "node", "n", "d", "near"))
    side = lambda s: rows.select("root", "token", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "d", "near", "pos")])
    # a: a set not linked to the root. b: one that is, or another with a larger number.
    roles = F.col("near_b") | (F.col("node_a") < F.col("node_b"))
    most = most_differing(F.col("n_a"), F.col("n_b"), t)
    left = F.least(F.col("d_a") - F.col("pos_a"), F.col("d_b") - F.col("pos_b"))
    fit = sizes_fit(F.col("n_a"), F.col("n_b"), t) & (2 * left >= F.col("d_a") + F.col("d_b") - most)
    pairs = side("a").where(~F.col("near_a")).join(side("b"), ["root", "token"]).where(roles & fit)
    pairs = pairs.select("root", "near_b", "node_a", "node_b", "n_a", "n_b").distinct()
    held = lambda s: deltas.select(F.col("node").alias(f"node_{s}"), F.col("delta").alias(f"delta_{s}"))
    both = checkpointed(pairs).join(held("a"), "node_a").join(held("b"), "node_b").withColumn("x", differing("delta_a", "delta_b"))
    found = both.where(F.col("x") <= most_differing(F.col("n_a"), F.col("n_b"), t))
    # All sets linked to the root are one component, so one link to any of them does for the rest.
    links = found.select(F.col("node_a").alias("a"), F.when(F.col("near_b"), F.col("root")).otherwise(F.col("node_b")).alias("b"))
    return spanning(links.distinct())


def qualifying(placed: DataFrame, percent: int) -> DataFrame:
    """(q, n_q, fam, part, g_lo, g_hi): sets and the groups of other families that may hold a link, by the counts of the
    token-group matrix of `placed` (token, node, n, pos, fam, part, size)."""
    t = percent
    spread = checkpointed(placed.groupBy("token").agg(F.min("fam").alias("lo"), F.max("fam").alias("hi")).where("lo <> hi").select("token"))
    placed = checkpointed(placed.join(spread, "token", "left_semi"))
    matrix = placed.groupBy("token", "fam", "part", "size").agg(F.min("pos").alias("g_pos"), F.min("n").alias("g_lo"), F.max("n").alias("g_hi"))
    asks = placed.select("token", F.col("node").alias("q"), F.col("n").alias("n_q"), F.col("pos").alias("q_pos"), F.struct("size", "fam").alias("rank"))
    # Member sizes that fit the query lie from `low` to `high`.
    low = lambda: F.greatest(F.col("g_lo"), _ceil_div(F.col("n_q") * t, 100))
    high = lambda: F.least(F.col("g_hi"), F.floor(F.col("n_q") * 100 / t))
    # If this is the first token that they share, what comes after it must do; this token joins them.
    near = ((100 + t) * (F.col("n_q") - F.col("q_pos")) >= t * (F.col("n_q") + low())) & ((100 + t) * (high() - F.col("g_pos")) >= t * (F.col("n_q") + high()))
    met = asks.join(matrix, "token").where((F.col("rank") < F.struct("size", "fam")) & (low() <= high()) & near).select("q", "n_q", "fam", "part").distinct()
    # Those that met, with all tokens that they share.
    met = checkpointed(met).join(asks.select("q", "token"), "q").join(matrix.select("token", "fam", "part", "g_lo", "g_hi"), ["token", "fam", "part"])
    counted = met.groupBy("q", "n_q", "fam", "part").agg(F.count(F.lit(1)).alias("c"), F.min("g_lo").alias("g_lo"), F.max("g_hi").alias("g_hi"))
    # The least count is lowest at the smallest or at the largest size.
    least = F.least(least_shared(F.col("n_q"), low(), t), least_shared(F.col("n_q"), high(), t))
    return counted.where((low() <= high()) & (F.col("c") >= least)).select("q", "n_q", "fam", "part", low().alias("g_lo"), high().alias("g_hi"))


def group_unions(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(fam, part, union) of groups (fam, part, node) of bounded size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        union = np.unique(np.concatenate(_rows(pdf["tokens"])))
        return pd.DataFrame({"fam": pdf["fam"].iloc[:1], "part": pdf["part"].iloc[:1], "union": [union.tobytes()]})

    return members.select("fam", "part", "node").join(sets, "node").select("fam", "part", "tokens").groupBy("fam", "part").applyInPandas(run, "fam long, part int, union binary")


def cross_family_links(rows: DataFrame, facts: DataFrame, texts: DataFrame, fams: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links between sets of different families; None without a qualifying group."""
    members = fams.select("node", F.col("root").alias("fam")).join(facts.select("node", "n"), "node")
    sizes = checkpointed(members.groupBy("fam").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("f_tokens")))
    split = F.greatest(F.ceil(F.col("size") / GROUP), F.ceil(F.col("f_tokens") / GROUP_TOKENS))
    members = checkpointed(members.join(sizes, "fam").select("node", "n", "fam", "size", F.pmod(F.xxhash64("node"), split).cast("int").alias("part")))
    placed = rows.join(members.drop("n"), "node", "left").select("token", "node", "n", "pos", F.coalesce("fam", "node").alias("fam"), F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("size", F.lit(1)).alias("size"))
    asked = checkpointed(qualifying(placed, percent))
    if not has_rows(asked):
        return None
    # Sets that step 3 didn't fetch: queries, and groups of one, whose node is their family.
    alone = asked.join(sizes.select("fam"), "fam", "left_anti").select("q", "n_q", "fam")
    ends = asked.select(F.col("q").alias("node")).unionByName(alone.select(F.col("fam").alias("node"))).distinct().join(sets.select("node"), "node", "left_anti")
    ends = checkpointed(ends.join(facts, "node").select("node", "key", "hi", "lo"))
    if has_rows(ends):
        # The filters drop nothing; without them Spark fails to derive constraints of a union of checkpoints in a self-join.
        sets = sets.where("tokens is not null").unionByName(checkpointed(token_sets(texts, ends, k)).where("tokens is not null"))
    several = asked.join(sizes.select("fam"), "fam", "left_semi")
    unions = group_unions(members.join(several.select("fam", "part").distinct(), ["fam", "part"], "left_semi"), sets)
    inside = several.join(sets.select(F.col("node").alias("q"), "tokens"), "q").join(unions, ["fam", "part"]).withColumn("overlap", token_overlap("tokens", "union"))
    # The size nearest to the query's own asks for least.
    inside = inside.where(linkable(F.least("overlap", "n_q"), F.col("n_q"), F.col("g_lo"), percent))
    opened = inside.select("q", "n_q", "fam", "part").join(members.select("fam", "part", F.col("node").alias("b"), F.col("n").alias("n_b")), ["fam", "part"])
    pairs = opened.where(sizes_fit(F.col("n_q"), F.col("n_b"), percent)).select(F.col("q").alias("a"), "b", F.col("n_q").alias("n_a"), "n_b")
    single = alone.join(facts.select(F.col("node").alias("fam"), F.col("n").alias("n_b")), "fam").select(F.col("q").alias("a"), F.col("fam").alias("b"), F.col("n_q").alias("n_a"), "n_b")
    return verified(checkpointed(pairs.unionByName(single)), sets, percent)


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after links (a, b) between components or lone nodes."""
    side = lambda s: comps.select(F.col("node").alias(s), F.col("comp").alias(f"c_{s}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).distinct()
    above = components(between)
    known = comps.join(above.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    fresh = above.join(comps.select("node"), "node", "left_anti")
    return known.unionByName(fresh.select("node", "comp"))


def _found(docs: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """(id, key, n, comp, name) of every row: `comp` is null where its set links with no other and has no copy, `name` is the
    smallest id of the component."""
    texts = keyed(docs, id_col, text)
    prints = checkpointed(fingerprints(texts, k, percent).withColumn("r", F.monotonically_increasing_id()))
    narrow = prints.drop("pool")
    sets_of = checkpointed(narrow.where("n > 0").groupBy("hi", "lo").agg(F.min("r").alias("node"), F.min("id").alias("name"), F.count(F.lit(1)).alias("copies")))
    copies = checkpointed(narrow.where("n > 0").join(sets_of.where("copies > 1").select("hi", "lo", "node"), ["hi", "lo"]).where("r <> node").select("r"))
    nodes = without_keys(prints.where("n > 0").select("r", "pool"), "r", copies).withColumnRenamed("r", "node")
    facts = narrow.withColumnRenamed("r", "node")
    rows = checkpointed(prefix_rows(nodes, facts, percent))
    release(docs.sparkSession)  # here and below, where much was shuffled for what is checkpointed now
    fams = checkpointed(centred(checkpointed(roots(checkpointed(leaders(rows, percent)))), rows, percent))
    sets = checkpointed(token_sets(texts, checkpointed(fams.select("node").join(facts, "node")), k))
    release(docs.sparkSession)
    deltas = checkpointed(differences(fams, facts, sets, percent))
    release(docs.sparkSession)
    near = deltas.where("near").select("node", F.col("root").alias("comp"))
    comps = checkpointed(near.unionByName(near.select(F.col("comp").alias("node"), "comp").distinct()))
    links = [checkpointed(family_links(deltas, percent))]
    release(docs.sparkSession)
    links.append(cross_family_links(rows, facts, texts, fams, sets, k, percent))
    more = checkpointed(reduce(DataFrame.unionByName, [x for x in links if x is not None]))
    release(docs.sparkSession)
    if has_rows(more):
        comps = checkpointed(merged(comps, more))
    # Names of components of several nodes; all others have their own.
    named = sets_of.join(comps, "node").select("hi", "lo", "comp", "name")
    names = checkpointed(named.groupBy("comp").agg(F.min("name").alias("c_name")))
    named = named.join(names, "comp").select("hi", "lo", "comp", "c_name")
    known = sets_of.join(named, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("comp", F.when(F.col("copies") > 1, F.col("node"))).alias("comp"), F.when(F.col("comp").isNull(), F.col("name")).otherwise(F.col("c_name")).alias("name"))
    known = checkpointed(known)
    release(docs.sparkSession)
    empty = narrow.where("n = 0").select("id", "key", "n", F.lit(None).cast("long").alias("comp"), F.col("id").alias("name"))
    full = narrow.where("n > 0").join(known, ["hi", "lo"], "left").select("id", "key", "n", "comp", "name")
    return full.unionByName(empty)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every row of `docs`, for shingles of k words and a similarity of percent / 100."""
    return _found(docs, id_col, text, k, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component, the one of the smallest id (null ids last), all columns kept. Rows without
    words stay."""
    found = checkpointed(_found(docs, id_col, text, k, percent).where("comp is not null").select("id", "key", "comp"))
    stays = checkpointed(found.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("x")).select("comp", "x.key"))
    gone = found.join(stays.withColumnRenamed("key", "stays"), "comp").where("key <> stays").select("key").distinct()
    twice = found.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key").join(stays, "key", "left_semi")
    keys = checkpointed(gone.withColumn("k", F.lit(False)).unionByName(twice.withColumn("k", F.lit(True))))
    release(docs.sparkSession)
    whole = packed(docs, key=row_key(id_col, text))
    kept = without_keys(whole, "key", checkpointed(keys.select("key")))
    again = likely_keys(whole, "key", keys.where("k").select("key")).join(keys.where("k").select("key"), "key", "left_semi").dropDuplicates(["key"])
    return kept.unionByName(again).select("row.*")
