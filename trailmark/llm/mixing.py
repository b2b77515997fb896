"""Operator 1, mixing sources to target weights, by iterative proportional fitting.

Documents fall into cells of (source, language, topic); each cell starts with its share of tokens. A sweep scales the
cells so that the sums over each dimension in turn reach that dimension's target shares; sweeps repeat until all three
hold. A cell's rate is its fitted share of the token budget over the tokens that it has: the expected number of times each
of its documents is taken. `copies` is the whole part of the rate, plus one with the probability of the rest, drawn
by a hash of the id, so the expected tokens of every source, language and topic meet the targets and reruns agree.

The topic is a column that the caller names, or else a form of text: legal, table, noise, exclaimed or prose, by the
first of four patterns found. `weight` is a cell's fitted share per token, relative to the table's mean; `rate` is that times
budget over tokens, so the two are one number where the budget is all tokens.

Scale: nothing but cell sums is shuffled, combined before the shuffle. Where the counted cells are at most `SMALL_CELLS`,
fitting runs in windows over them, four sweeps to a checkpoint, and rates reach the documents by broadcast. Beyond that each
margin is a grouped sum, combined before its shuffle and joined back to the cells, each written (`Rounds`), and rates are
joined by a shuffle; Spark splits the partitions of a hot value, since sums are checkpointed before their join. With
`columns` only those travel with a document, and its text is read once; else it is read twice.

Nulls: a null source or language is a value of its own, named `(none)`; a null text has no tokens and the topic of
an empty one. Cells without tokens have rate 0, as have values whose target is 0 or missing. A null id draws as the empty
string. Repeated rows of an id draw alike. Targets of values that the table lacks are spread over the others. Very long
texts are counted where they are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rounds, checkpointed

NONE = "(none)"
DIMENSIONS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
#: Topics by form of text: the first pattern found names it; else OTHER.
TOPICS = (("legal", "[Ll]icen[sc]e"), ("table", r" \| "), ("noise", "[#$%&*]{3}"), ("exclaimed", "[A-Z]!!"))
OTHER = "prose"
SMALL_CELLS = 100_000
SWEEPS = 24
ROUND = 4
TOLERANCE = 1e-9


def topic_of(text: Column, topics=TOPICS) -> Column:
    found = F.lit(OTHER)
    for name, pattern in reversed(topics):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def tempered(cells: DataFrame, dimension: str, alpha: float) -> dict | DataFrame:
    """(value, share): token shares of a dimension to the power `alpha`; 1 keeps them, 0 makes them even."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    return sums.select("value", F.pow(F.col("tokens").cast("double"), F.lit(float(alpha))).alias("share"))


def _normalised(target: DataFrame) -> DataFrame:
    total = target.agg(F.sum("share").alias("x")).first()["x"]
    return target.select("value", (F.col("share") / F.lit(total or 1.0)).alias("share"))


def _scaled(fitted: DataFrame, d: str, rounds: Rounds | None) -> DataFrame:
    """`fitted` with `w` scaled to the goals of dimension `d`, and `by_<d>`, the factor. Without `rounds` in windows, else by
    grouped sums."""
    if rounds is None:
        summed = fitted.withColumn("margin", F.sum("w").over(Window.partitionBy(d)))
    else:
        margins = rounds.put("margins", fitted.groupBy(d).agg(F.sum("w").alias("margin")))
        summed = fitted.join(margins, d)
    factor = F.when(F.col("margin") > 0, F.coalesce(f"goal_{d}", F.lit(0.0)) / F.col("margin")).otherwise(0.0)
    scaled = summed.withColumn(f"by_{d}", factor).withColumn("w", F.col("w") * F.col(f"by_{d}")).drop("margin")
    return scaled if rounds is None else rounds.put("fitted", scaled)


def fit(cells: DataFrame, targets: dict[str, DataFrame | dict[str, float]], sweeps: int = SWEEPS, tolerance: float = TOLERANCE, small_cells: int = SMALL_CELLS) -> DataFrame:
    """`cells` (the dimensions, tokens) with `w`, the fitted shares. A target is (value, share) rows or a dict.

    Sweeps run in rounds of `ROUND` with a checkpoint and a look at the largest correction of the last sweep, until it is
    below `tolerance` or `sweeps` are done.
    """
    spark = cells.sparkSession
    facts = cells.agg(F.sum("tokens").alias("x"), F.count(F.lit(1)).alias("k")).first()
    total, small = facts["x"] or 1, facts["k"] <= small_cells
    fitted = cells.withColumn("w", F.col("tokens").cast("double") / total)
    for d, target in targets.items():
        rows = spark.createDataFrame(list(target.items()), "value string, share double") if isinstance(target, dict) else target
        there = cells.where("tokens > 0").select(F.col(d).alias("value")).distinct()
        goal = _normalised(rows.join(there, "value", "left_semi"))
        fitted = fitted.join(goal.select(F.col("value").alias(d), F.col("share").alias(f"goal_{d}")), d, "left")
    rounds = None if small else Rounds(spark)
    fitted = checkpointed(fitted) if small else rounds.put("fitted", fitted)
    for done in range(0, sweeps, ROUND):
        for _ in range(done, min(sweeps, done + ROUND)):
            for d in targets:
                fitted = _scaled(fitted.drop(f"by_{d}"), d, rounds)
        fitted = checkpointed(fitted) if small else fitted
        off = F.greatest(*[F.abs(F.col(f"by_{d}") - 1) for d in targets])
        worst = fitted.where("w > 0").agg(F.coalesce(F.max(off), F.lit(0.0)).alias("x")).first()["x"]
        if worst < tolerance:
            break
    if rounds:
        rounds.close("fitted")
    return fitted.select(*targets, "tokens", "w")


def mix(docs: DataFrame, alpha: dict[str, float], budget: int | None = None, targets: dict | None = None, seed: str = "mix", id_col: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", topic: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """`docs`, or its `columns`, packed as struct `row`, with topic, n_tokens, weight (of each token), rate and copies.

    Targets are shares of values per dimension (an empty one gives rate 0), or token shares tempered by `alpha`; `budget` is in tokens, by default
    those that the table has. `topic` names a column of topics.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)]).alias("row"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(source).cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col(lang).cast("string"), F.lit(NONE)).alias("lang"),
        (F.coalesce(F.col(topic).cast("string"), F.lit(NONE)) if topic else topic_of(body)).alias("topic"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_tokens"),
    )
    if columns is not None:
        rows = checkpointed(rows)
    cells = checkpointed(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    goals = {d: targets[d] if targets and d in targets else tempered(cells, d, alpha[d]) for d in DIMENSIONS}
    total = cells.agg(F.sum("tokens").alias("x"), F.count(F.lit(1)).alias("k")).first()
    size = float(budget if budget is not None else total["x"] or 0)
    fitted = fit(cells, goals)
    share = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    rates = fitted.select(*DIMENSIONS, F.round(share * (total["x"] or 0), 6).alias("weight"), F.round(share * size, 6).alias("rate"))
    joined = rows.join(F.broadcast(rates) if total["k"] <= SMALL_CELLS else rates, list(DIMENSIONS))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    whole = F.floor("rate")
    copies = whole + F.when(draw < F.round(F.col("rate") - whole, 6), 1).otherwise(0)
    return joined.select("row", F.col("topic"), "n_tokens", "weight", "rate", copies.cast("long").alias("copies"))
