"""Operator 2, token counts, by an exact length histogram.

Each document is encoded once with a public byte-pair vocabulary, and only its length is kept. Documents are counted by
length, with counts combined before the shuffle. Suffix sums over the histogram then answer, for every context limit L
that is some document's length, how many documents and tokens reach it, and how many tokens remain if documents are cut at
L; between two lengths these are linear in L, so `at_limits` answers any limit exactly.

Scale: the histogram has at most as many rows as the longest document has tokens. Suffix sums are two-level: lengths are
dealt into ranges of `RANGE`, sums within a range are independent windows, and only one row per range meets in the window
over ranges. A hot length is one row. Memory is bounded by one batch of texts.

Nulls: a null text has length 0, as an empty one. An empty table gives an empty histogram. Repeated rows count each. A very long
text is encoded whole, in the row where it is read. Documents of one length are one row, so there are no ties. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RANGE = 256


def load_encoding(path: str):
    """The byte-pair encoding of the vocabulary file at `path` (lines of base64 token and rank)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length) of every row's text in tokens. `vocabulary` is a path that every executor can open."""

    @F.pandas_udf(T.LongType())
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_encoding(vocabulary)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return docs.select(length(F.col(text)).alias("length"))


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs), checkpointed, so that its uses don't encode the texts again."""
    return checkpointed(token_lengths(docs, text, vocabulary).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L: documents and tokens at L, `docs_from` and `tokens_from` of documents of length L or more,
    `kept_tokens` if documents are cut at L, `cut_tokens`, and `quantile`, the share of documents of length L or less."""
    rows = histogram.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("part", F.floor(F.col("length") / RANGE))
    parts = rows.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each RANGE lengths
    everything = Window.partitionBy()
    parts = parts.select("part", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(everything).alias("docs"), F.sum("t").over(everything).alias("tokens"))
    within = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(parts, "part").withColumn("docs_from", F.sum("n_docs").over(within) + F.col("d_after")).withColumn("tokens_from", F.sum("n_tokens").over(within) + F.col("t_after"))
    kept = F.col("tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    return rows.select(
        "length", "n_docs", "n_tokens", "docs_from", "tokens_from", kept.alias("kept_tokens"), (F.col("tokens") - kept).alias("cut_tokens"),
        F.round((F.col("docs") - F.col("docs_from") + F.col("n_docs")) / F.col("docs"), 9).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents longer than it, tokens kept and cut when documents are cut at it."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    longer = sums.join(F.broadcast(asked), F.col("length") > F.col("context"), "right").groupBy("context")
    found = longer.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("longer_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("longer_tokens"))
    total = sums.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("x")).first()["x"]
    cut = F.col("longer_tokens") - F.col("context") * F.col("longer_docs")
    return found.select("context", "longer_docs", (F.lit(total) - cut).alias("kept_tokens"), cut.alias("cut_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the smallest length that at least that share of documents doesn't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.join(F.broadcast(asked), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
