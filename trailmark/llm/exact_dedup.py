"""Operator 4, exact dedup, by DataFrame functions alone.

Progressive refinement. Texts are equal when they are identical after deleting ASCII white space.

1. One narrow scan gives each row's normalised length and a hash of its normalised prefix.
2. Rows are counted by length, and within repeated lengths by (length, prefix hash). Counts combine before the
   shuffle, so a group of copies of any size sends one row per task.
3. The repeated (length, prefix hash) pairs fill a filter of a bounded number of bits, small enough to broadcast. Only
   rows that pass it have their full content hashed; no text is shuffled for it. Where there are too many pairs for a
   filter, all rows are hashed.
4. Equal full hashes (SHA-256) of equal length form a group. Groups are checkpointed before they are joined back, so that
   Spark splits the partition of a group that holds a third of all rows.

Nulls: a null text counts as empty. Rows with a null id take part; they lose ties against rows with one. Repeated rows
of one id count each in `group_size`; of rows of one id whose texts differ in white space only the longest is `kept`, and rows
of one id and length are alike and marked alike; `drop_copies` leaves one of them. Ids are numbers. A very long text is hashed where it
is read. An empty table gives an empty result. Names of input columns can't clash: they travel in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed, parted

#: Characters that normalisation deletes (fixed values): blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
#: Code points of the normalised text that the prefix hash reads.
PREFIX = 128


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _features(df: DataFrame) -> DataFrame:
    norm = df.withColumn("xd_norm", normalised(F.col("xd_text"))).withColumn("xd_len", F.length("xd_norm"))
    return norm.withColumn("xd_prefix", F.xxhash64("xd_len", F.substring("xd_norm", 1, PREFIX)))


def repeated_prefixes(df: DataFrame) -> DataFrame:
    """(xd_prefix): hashes of (length, prefix) that more than one row has, counted within repeated lengths only."""
    narrow = checkpointed(_features(df).select("xd_len", "xd_prefix"))
    length = F.col("xd_len").cast("long")
    lengths = checkpointed(narrow.groupBy(length.alias("len")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len"))
    rows, _ = parted(narrow, length, lengths)
    return checkpointed(rows.groupBy("xd_len", "xd_prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("xd_prefix"))


def _hashed(df: DataFrame, digest: bool = False) -> DataFrame:
    """`df` (xd_id, xd_text and others) with `xd_points`, the code points of the original text, and `xd_full`, the
    SHA-256 of the normalised text, null for rows that the length and the prefix hash prove to be alone; with `digest` also
    `xd_digest`, that of every row, from which xd_full is taken."""
    full = F.sha2(F.col("xd_norm").cast("binary"), 256)
    rows = _features(df).withColumn("xd_points", F.length(F.coalesce("xd_text", F.lit(""))))
    if digest:
        rows, full = rows.withColumn("xd_digest", full), F.col("xd_digest")
    doubt, alone = parted(rows.drop("xd_text"), F.col("xd_prefix"), repeated_prefixes(df))
    rows = doubt.withColumn("xd_full", full).unionByName(alone.withColumn("xd_full", F.lit(None).cast("string")))
    return rows.drop("xd_norm", "xd_len", "xd_prefix")


def _groups(rows: DataFrame) -> DataFrame:
    """(xd_full, xd_size, xd_keep) of full hashes that several rows have: most code points, then smallest id stays."""
    best = F.max(F.struct("xd_points", (-F.col("xd_id")).alias("neg"))).alias("best")
    found = rows.where("xd_full is not null").groupBy("xd_full").agg(F.count(F.lit(1)).alias("xd_size"), best)
    return checkpointed(found.where("xd_size > 1").select("xd_full", "xd_size", (-F.col("best.neg")).alias("xd_keep"), F.col("best.xd_points").alias("xd_most")))


def exact_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of `df`: the id, `keep_id`, `group_size`, `kept`; with `digest` also `text_sha256` of every
    normalised text (which reads the full content of all rows, as a report may want)."""
    slim = df.select(F.col(id_col).alias("xd_id"), F.col(text).alias("xd_text"))
    rows = checkpointed(_hashed(slim, digest))
    # Rows proved to be alone have no hash; kept out of the join, they can't meet in the task of its null keys.
    lone = rows.where("xd_full is null").withColumns({"xd_size": F.lit(None).cast("long"), "xd_keep": F.lit(None).cast("long"), "xd_most": F.lit(None).cast("int")})
    joined = rows.where("xd_full is not null").join(_groups(rows), "xd_full", "left").unionByName(lone)
    keep = F.when(F.col("xd_size").isNull(), F.col("xd_id")).otherwise(F.col("xd_keep"))
    extra = [F.col("xd_digest").alias("text_sha256")] if digest else []
    return joined.select(
        F.col("xd_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("xd_size", F.lit(1)).cast("long").alias("group_size"),
        (keep.eqNullSafe(F.col("xd_id")) & F.coalesce(F.col("xd_most") == F.col("xd_points"), F.lit(True))).alias("kept"),
        *extra,
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with one row of each group of equal texts, all columns kept.

    Rows that the refinement proves to be alone pass straight through; only members of groups are shuffled.
    """
    rows = _hashed(packed(df, xd_id=F.col(id_col), xd_text=F.col(text)))
    found = _groups(rows.select("xd_id", "xd_points", "xd_full"))
    key = F.when(F.col("xd_full").isNotNull(), F.xxhash64("xd_full"))
    doubt, rest = parted(rows, key, found.select(F.xxhash64("xd_full").alias("h")))
    member = doubt.where("xd_full is not null").join(found, "xd_full", "left")
    alone = member.where("xd_size is null")
    stays = member.where("xd_size is not null and xd_keep <=> xd_id").dropDuplicates(["xd_full"])
    parts = [x.select("row.*") for x in (rest, doubt.where("xd_full is null"), alone, stays)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
