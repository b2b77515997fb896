"""A pipeline over `documents` in five stages, each of which works on all that its predecessor kept.

Counted as part of the subpackage `trailmark.llm`. Each stage takes (spark, docs, sf_dir) and returns a DataFrame.

All stages take nulls in any column, empty and very long texts (read whole, in one row), repeated rows, an empty table (which
gives an empty one) and extra columns, which stay as they are whatever their names. Each stage says what it does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm.common import checkpointed, read_table
from trailmark.llm.decontaminate import drop_contaminated
from trailmark.llm.exact_dedup import drop_copies
from trailmark.llm.language_id import calibrated, drop_unidentified
from trailmark.llm.mixing import mix
from trailmark.llm.ngram_join import drop_near_copies
from trailmark.llm.queries import MIX_ALPHA


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text one of the labelled languages can be told. Null and empty texts, and those without a letter, go;
    repeated rows stay or go together. Without any label, texts with a letter stay."""
    return drop_unidentified(docs, calibrated(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, null and empty ones being equal: the longest original, then the smallest id,
    null ids last. Of repeated rows one stays."""
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles to a Jaccard similarity of 0.8 or more: the smallest id, null ids
    last. Texts without words link with nothing and stay. Of repeated rows one stays."""
    return drop_near_copies(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts stay; repeated rows stay or go together. An empty
    benchmark drops nothing."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at least once for the mixture, with how often (`copies`) and the weight of a token; a column of
    `docs` that has one of these names keeps its own values. Documents without words have weight and cost nothing: their cell's
    rate is drawn as for any other; null sources and languages are values of their own; repeated rows are drawn alike."""
    mixed = mix(docs, MIX_ALPHA).where("copies > 0")
    return mixed.select("row.*", *[c for c in ("topic", "n_tokens", "weight", "rate", "copies") if c not in docs.columns])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]
#: Language ID learns a model, which SQL doesn't restate; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared checkpoint folder for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
