"""Operator 3, language ID, by language-bitmask n-gram filters.

A Bloom filter for each language holds the character n-grams that are typical of it. The filters are bit-sliced: one
array has, at each position, a mask with a bit for each language, so that one look-up of an n-gram's positions and an AND
of the masks return all languages that contain it. Each 64 languages have an array of their own, and the largest corrected
share over all arrays decides. A document's n-grams are looked up over its whole text; for each
language the hits are counted (popcount of its bit) and corrected for the share that its filter's fill would let
through by chance. The highest corrected count decides.

The filters are fitted on the whole texts of all labelled documents, counted by Spark; their size is 8 bytes for each of the `slots` and each 64 languages, so they may be broadcast.
Prediction reads nothing but text. Texts are worked on in pieces of bounded length, so a very long text needs no more memory
than many short ones; Python gets them in Arrow batches of at most 64 MB.

A corpus is cleaned by the score (`drop_unidentified`): noise and languages that weren't learned hit few n-grams. The
least score of a language comes from labelled rows, scored by filters that were fitted without them.

Nulls and empties: a null text, or one without a letter, is `und` with score 0. Rows without a language, text or id are
not learned from. A text whose n-grams are all unknown gets the language with most training documents (the first by
name on ties), with score 0; ties go to the first language by name. Without labelled rows every document is `und`.
Repeated rows are each learned from and each answered, alike. An empty table gives an empty result. Input columns travel in
a struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

UNKNOWN = "und"
SLOTS = 1 << 21
HASHES = 3
SIZES = (2, 4)  # lengths of n-grams
MIN_SHARE = 2e-5  # of a language's n-grams of one length, from which an n-gram is typical
MIN_RATIO = 0.1  # to the largest share of the n-gram in any language
FOLDS = 5  # one of them calibrates the least scores
LOW = 0.001  # quantile of the scores of a language's labelled rows, the base of its least score
MARGIN = 0.5  # of that quantile, still kept: texts of a few words score far lower than others
MIN_SCORED = 20  # labelled rows that a least score needs
PIECE = 1 << 19  # characters that are worked on at once
COUNTED = 1 << 22  # characters of training texts whose n-grams are counted at once
BITS = 64  # languages of an array
#: Odd multipliers of the hashes (fixed values).
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_BLANK = np.uint32(32)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text between blanks; each run of other characters than letters is one blank."""
    c = _lowered(f" {text} ")
    return c[np.concatenate(([True], (c[1:] != _BLANK) | (c[:-1] != _BLANK)))]


def _lowered(text: str) -> np.ndarray:
    """Code points of the lower-cased text, all but letters blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    return np.where(_letter_table()[c], c, _BLANK)


_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point of Unicode whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(c: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the n-grams of `size` characters, one for each place."""
    n = len(c) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.full(n, size, np.uint64)
    for i in range(size):
        x = (x ^ c[i : i + n].astype(np.uint64)) * ODD[i % 3]
        x ^= x >> np.uint64(29)
    return x


def positions(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    return [((grams * ODD[j]) >> np.uint64(40)).astype(np.int64) & (slots - 1) for j in range(HASHES)]


def lettered(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """What `letters` gives for a text, in parts of bounded length: each with the last characters of the part before, so that no
    n-gram is lost, and how many these are, so that none is counted twice."""
    keep = max(SIZES) - 1
    tail = np.empty(0, np.uint32)
    for start in range(0, len(text), PIECE):
        c = _lowered(" " * (start == 0) + text[start : start + PIECE] + " " * (start + PIECE >= len(text)))
        before = tail[-1] if len(tail) else np.uint32(0)
        c = c[(c != _BLANK) | (np.concatenate(([before], c[:-1])) != _BLANK)]
        yield np.concatenate([tail, c]), len(tail)
        tail = np.concatenate([tail, c])[-keep:]


def pieces(text: str) -> Iterator[str]:
    """Parts of a text of bounded length."""
    for start in range(0, len(text), PIECE):
        yield text[start : start + PIECE]


class Filters:
    """Bit-sliced filters: masks by array and slot (or by slot alone), and the languages of the bits, array by array."""

    def __init__(self, langs: list[str], masks: np.ndarray, default: int):
        self.langs, self.masks, self.default = langs, np.atleast_2d(masks), default
        self.least: dict[str, float] = {}  # score by language, below which a text is in none of them
        fill = np.array([((self.masks[i // BITS] >> np.uint64(i % BITS)) & np.uint64(1)).mean() for i in range(len(langs))]) if langs else np.empty(0)
        self.chance = fill**HASHES

    def containing(self, grams: np.ndarray, array: int = 0) -> np.ndarray:
        """Mask of the languages of an array that contain each n-gram."""
        found, masks = None, self.masks[array]
        for at in positions(grams, len(masks)):
            found = masks[at] if found is None else found & masks[at]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        hits, total, some = np.zeros(len(self.langs)), 0, False
        for c, old in lettered(text):
            some = some or bool((c != _BLANK).any())
            for size in SIZES:
                grams = ngrams(c[max(0, old - size + 1) :], size)
                if len(grams):
                    found = [self.containing(grams, array) for array in range(len(self.masks))]
                    total += len(grams)
                    hits += [np.count_nonzero(found[i // BITS] & np.uint64(1 << i % BITS)) for i in range(len(self.langs))]
        if not some:
            return UNKNOWN, 0.0
        share = np.clip((hits / total - self.chance) / (1 - self.chance), 0, 1)
        best = int(np.argmax(share))
        return (self.langs[best], float(round(share[best], 6))) if share[best] > 0 else (self.langs[self.default], 0.0)

    def tells(self, text: str | None) -> bool:
        """Whether the text is in a language that was learned; if there is none, whether it has a letter."""
        if not self.langs:
            return any(c.isalpha() for c in text or "")
        lang, score = self.predict(text)
        return score > 0 and score >= self.least.get(lang, 0.0)


def training_rows(docs: DataFrame, lang: str, text: str, id_col: str) -> DataFrame:
    """(lang, text, fold) of all labelled rows; `fold` says whether the row is in the fold that calibrates."""
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null and id is not null")
    return labelled.select("lang", "text", (F.pmod(F.xxhash64("id", F.lit(23)), F.lit(FOLDS)) == 0).alias("fold"))


def count_grams(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, fold, size, gram, n) and (lang, fold, k) of training rows: how often each n-gram stands in them, and the documents."""

    def counted_in(name: str, fold: bool, texts: list[str]) -> Iterator[pd.DataFrame]:
        c = letters(" ".join(texts))
        for size in SIZES:
            gram, n = np.unique(ngrams(c, size), return_counts=True)
            yield pd.DataFrame({"lang": name, "fold": bool(fold), "size": size, "gram": gram.view(np.int64), "n": n})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (name, fold), texts in batch.groupby(["lang", "fold"])["text"]:
                held, size = [], 0
                for piece in (p for t in texts for p in pieces(t)):
                    held.append(piece)
                    size += len(piece)
                    if size >= COUNTED:
                        yield from counted_in(name, fold, held)
                        held, size = [], 0
                yield from counted_in(name, fold, held)

    counted = rows.mapInPandas(count, "lang string, fold boolean, size int, gram long, n long").groupBy("lang", "fold", "size", "gram").agg(F.sum("n").alias("n"))
    return checkpointed(counted), checkpointed(rows.groupBy("lang", "fold").agg(F.count(F.lit(1)).alias("k")))


def filters_of(grams: DataFrame, sizes: DataFrame, slots: int = SLOTS) -> Filters:
    """Filters of all languages that `count_grams` has counted."""
    counts = {r["lang"]: r["k"] for r in sizes.groupBy("lang").agg(F.sum("k").alias("k")).collect()}
    langs = sorted(counts)
    masks = np.zeros((max(1, -(-len(langs) // BITS)), slots), np.uint64)
    if not langs:
        return Filters([], masks, 0)
    counted = grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    shares = counted.join(F.broadcast(totals), ["lang", "size"]).withColumn("share", F.col("n") / F.col("total"))  # totals: a row for each language and length
    top = shares.groupBy("size", "gram").agg(F.max("share").alias("top"))
    typical = shares.where(F.col("share") >= MIN_SHARE).join(top, ["size", "gram"]).where(F.col("share") >= MIN_RATIO * F.col("top"))
    # 1 / MIN_SHARE bounds the typical n-grams of a language and length, and so the rows that come to the driver.
    order = {name: i for i, name in enumerate(langs)}
    rows = typical.select("lang", "gram").toLocalIterator()
    while chunk := list(islice(rows, 100_000)):
        bit = np.array([order[r["lang"]] for r in chunk])
        hashes = np.array([r["gram"] for r in chunk], np.int64).view(np.uint64)
        for at in positions(hashes, slots):
            np.bitwise_or.at(masks, (bit // BITS, at), np.uint64(1) << (bit % BITS).astype(np.uint64))
    return Filters(langs, masks, langs.index(min(counts, key=lambda k: (-counts[k], k))))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", slots: int = SLOTS) -> Filters:
    """Filters of all languages of `docs`."""
    return filters_of(*count_grams(training_rows(docs, lang, text, id_col)), slots)


def calibrated(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", slots: int = SLOTS) -> Filters:
    """Filters of all labelled rows of `docs`, with least scores. Those come from filters fitted without one fold of the
    ids and the labelled rows of that fold, so that rows learned by heart don't raise them; a language in which fewer
    than `MIN_SCORED` of these are found has none. Both filters come from one count of n-grams."""
    rows = training_rows(docs, lang, text, id_col)
    grams, sizes = count_grams(rows)
    filters = filters_of(grams, sizes, slots)
    scored = identify(rows.where("fold"), filters_of(grams.where("not fold"), sizes.where("not fold"), slots))
    low = scored.groupBy("lang_pred").agg(F.count(F.lit(1)).alias("k"), F.percentile("score", F.lit(LOW)).alias("q"))
    filters.least = {r["lang_pred"]: MARGIN * r["q"] for r in low.where(F.col("k") >= MIN_SCORED).collect()}
    return filters


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """`docs` packed as struct `row`, with `lang_pred` and `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("li_text"))
    return packed.select("row", predict("li_text").alias("p")).select("row", "p.lang_pred", "p.score")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept out of training: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def drop_unidentified(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """`docs` without those in which none of the languages can be told: no letter, no known n-gram, or a score below the
    language's least. Without any language, those without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("boolean")
    def tells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series([model.tells(t) for t in texts], dtype=bool)

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("li_text"))
    return packed.where(tells("li_text")).select("row.*")
