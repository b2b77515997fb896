"""Operator 10, URL filters, by a character language-model ratio, in DataFrame functions alone.

Rules decide the URLs that they fit. Those verdicts label two classes, accepted and rejected, for each of which a
smoothed variable-order Markov model of characters is learned: the probability of a character after a context of k
characters is interpolated with that after k - 1, down to single characters, and each position uses the longest context
whose n-gram was seen `MIN_COUNT` times or more. A URL without a rule gets the mean over its characters of the
log-likelihood difference of the two models, and is allowed from a threshold calibrated on labelled URLs kept out of the
counts. The models read whole URLs, query and fragment included, between a start and an end mark; rules read host and path.

Bounds: the models are fitted, and the threshold calibrated, on all labelled URLs, by joins and grouped counts. N-grams seen less than `MIN_COUNT` times are pruned at any size, being worth no more than their shorter contexts. A model of
at most `BROADCAST_GRAMS` n-grams is broadcast, a larger one is joined by a shuffle. Each distinct URL is scored once, under
a short number of its own, and is cut into characters once, so its cost is linear in its length.

Nulls: a null URL, or one without `://`, has an empty host and path, and no rule fits; the model judges its text, a null as
empty. Without labelled URLs every score is 0 and the verdict is allow. Repeated rows are judged alike and reported
each. Very long URLs are judged whole. An empty table gives an empty result; columns other than id and URL are ignored,
whatever their names. A URL that a third of all rows have is scored once, and Spark splits its partition in the join back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import LOWER, UPPER, checkpointed

# The rules, each a verdict and a host with a path prefix.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
ORDERS = 4  # an n-gram is a character with up to three before it
BETA = 4.0  # weight of the next shorter context
ALPHABET = 256
MIN_COUNT = 2
BROADCAST_GRAMS = 500_000
FOLDS = 5  # the last one calibrates
BINS = 100  # of the score, for a unit


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(urls: DataFrame) -> DataFrame:
    """A row for each character after the start mark, without `url_text`: g0 to g3, the n-grams of 1 to `ORDERS` characters
    that end there, null where they don't fit."""
    chars = urls.withColumn("c", F.regexp_extract_all("url_text", F.lit("(?s)."), F.lit(0))).drop("url_text")
    ends = F.expr("sequence(1, size(c) - 1)")
    gram = lambda i, k: F.when(i >= k, F.concat(*[F.get("c", i - j) for j in range(k, -1, -1)]))
    cut = F.transform(ends, lambda i: F.struct(*[gram(i, k).alias(f"g{k}") for k in range(ORDERS)]))
    return chars.withColumn("g", F.explode(cut)).select(*[c for c in urls.columns if c != "url_text"], "g.*")


def fit(labelled: DataFrame) -> DataFrame:
    """(gram, llr) from (url_text, accepted boolean, n): log-probability difference of the n-gram's last character."""
    grams = F.explode(F.array(*[f"g{k}" for k in range(ORDERS)]))
    yes = F.when(F.col("accepted"), F.col("n")).otherwise(0)
    counted = _grams(labelled.select("url_text", "accepted", "n")).select(grams.alias("gram"), yes.alias("a"), (F.col("n") - yes).alias("r")).where("gram is not null")
    counts = checkpointed(counted.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    total = counts.where("length(gram) = 1").agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    na, nr = float(total["a"] or 0), float(total["r"] or 0)
    even = 1.0 / ALPHABET
    level = counts.where("length(gram) = 1").select("gram", "a", "r", ((F.col("a") + BETA * even) / (na + BETA)).alias("pa"), ((F.col("r") + BETA * even) / (nr + BETA)).alias("pr"))
    levels = [level]
    for k in range(1, ORDERS):
        own = counts.where(F.length("gram") == k + 1).withColumn("context", F.expr(f"substring(gram, 1, {k})"))
        context = own.groupBy("context").agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        shorter = levels[-1].select(F.col("gram").alias("suffix"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        own = own.join(context, "context").withColumn("suffix", F.expr("substring(gram, 2)")).join(shorter, "suffix")
        levels.append(own.select("gram", "a", "r", ((F.col("a") + BETA * F.col("qa")) / (F.col("ca") + BETA)).alias("pa"), ((F.col("r") + BETA * F.col("qr")) / (F.col("cr") + BETA)).alias("pr")))
    model = checkpointed(reduce(DataFrame.unionByName, levels).select("gram", (F.col("a") + F.col("r")).alias("n"), (F.log("pa") - F.log("pr")).alias("llr")))
    return model.where((F.length("gram") == 1) | (F.col("n") >= MIN_COUNT)).select("gram", "llr")


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(u, score) of distinct (u, url_text): mean over characters of the longest known n-gram's difference."""
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _grams(urls.select("u", "url_text").repartition(tasks, "u"))
    small = model.count() <= BROADCAST_GRAMS
    for k in range(ORDERS):
        own = model.where(F.length("gram") == k + 1).select(F.col("gram").alias(f"g{k}"), F.col("llr").alias(f"llr{k}"))
        rows = rows.join(F.broadcast(own) if small else own, f"g{k}", "left").drop(f"g{k}")
    best = F.coalesce(*[F.col(f"llr{k}") for k in reversed(range(ORDERS))], F.lit(0.0))
    return rows.groupBy("u").agg(F.round(F.avg(best), 6).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The bin edge that best parts (score, accepted, n): highest sum of both hit rates, the one nearest 0 on ties."""
    edge = F.least(F.greatest(F.floor(F.col("score") * BINS), F.lit(-10 * BINS)), F.lit(10 * BINS)).alias("edge")
    yes = F.when(F.col("accepted"), F.col("n")).otherwise(0)
    bins = scored.groupBy(edge).agg(F.sum(yes).alias("a"), F.sum(F.col("n") - yes).alias("r"))  # at most 20 * BINS + 1 rows
    up = Window.orderBy("edge")
    below = bins.select("edge", F.sum("r").over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("r"), F.sum("a").over(up.rowsBetween(0, Window.unboundedFollowing)).alias("a"), F.sum("a").over(Window.partitionBy()).alias("na"), F.sum("r").over(Window.partitionBy()).alias("nr"))
    gain = F.coalesce(F.col("a") / F.col("na"), F.lit(0.0)) + F.coalesce(F.coalesce("r", F.lit(0)) / F.col("nr"), F.lit(0.0))
    best = below.orderBy(gain.desc(), F.abs("edge"), "edge").first()
    return best["edge"] / BINS if best else 0.0


def judge_urls(pages: DataFrame, rules=RULES, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict, score."""
    host, path = parts(F.col(url))
    text = F.concat(F.lit("\x02"), F.coalesce(F.col(url), F.lit("")), F.lit("\x03"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), text.alias("url_text"))
    rows = rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    texts = rows.groupBy("url_text").agg(F.first("fit.verdict").alias("verdict"))
    texts = checkpointed(texts.withColumn("u", F.monotonically_increasing_id()))
    labelled = texts.where("verdict is not null").withColumn("accepted", F.col("verdict") == "allow")
    labelled = labelled.withColumn("fold", F.pmod(F.xxhash64("url_text", F.lit(2)), F.lit(FOLDS)))
    # Counts are of distinct URLs, so that one repeated URL doesn't shape the models.
    model = checkpointed(fit(labelled.where(F.col("fold") < FOLDS - 1).withColumn("n", F.lit(1))))
    scored = checkpointed(score(texts, model))
    held = labelled.where(F.col("fold") == FOLDS - 1).select("u", "accepted").join(scored, "u")
    cut = calibrate(held.withColumn("n", F.lit(1)))
    by_text = checkpointed(texts.select("u", "url_text").join(scored, "u").select("url_text", "score"))
    judged = rows.join(by_text, "url_text", "left")
    own = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return judged.select(F.col("page_id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "score")
