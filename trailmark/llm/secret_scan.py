"""Operator 9, secret scans, by an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text (its blob). The ledger holds a row for each
(blob, rule version) pair scanned so far, with its findings. A run scans only pairs that the ledger lacks, one copy of
each blob, and joins findings back to all paths. A new rule version makes the pairs, and only those, unseen again.

The ledger is a table: `read_ledger` and `append_ledger` keep it at a path, new entries only, and an entry that a retried
append wrote twice counts once.

Scale: blobs are chosen on narrow rows (id and hash). Rows whose blob is neither repeated nor in the ledger are scanned
where they are read; a filter of a bounded number of bits tells them apart, and only the others are shuffled. A blob of
a third of all rows is counted by partial aggregates and scanned once; Spark splits its partition when findings are joined
back. Python gets texts in Arrow batches of at most 64 MB, and a longer text alone.

Nulls: a null text is the empty blob. Rows with a null id are scanned and reported. Repeated rows are reported each.
Offsets are code points, ends exclusive. Patterns take time in proportion to a text's length. An empty table gives an empty
result. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, parted

RULE_VERSION = "3"
LEDGER = "blob string, rule_version string, findings array<struct<kind:string,start:int,end:int>>"
#: Kinds in their order within one start: the base kinds, then those that this library adds.
KINDS = ("assign", "access", "hex", "private_key", "code_host", "chat", "jwt")

# The base patterns.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words one of which, in lower case, each match of ASSIGN holds.
ASSIGN_HINTS = ("passw", "secret", "token", "key")
# Public credential formats that this library adds, each with a string that every match holds. A token starts where
# its run of characters starts, so that a run is looked at from one place only.
ADDED = (
    ("private_key", "PRIVATE KEY", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")),
    ("code_host", "_", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{36,})")),
    ("chat", "xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}")),
)


def findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of one blob, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, hint, pattern in ADDED:
        if hint in text:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(SPANS)
def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in findings(t)] for t in batch])


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger at `path`, written by `append_ledger`."""
    return spark.read.schema(LEDGER).parquet(path)


def append_ledger(entries: DataFrame, path: str, ledger: DataFrame | None = None) -> None:
    """Appends to the ledger at `path` the `entries` that `ledger`, what it held before, lacks."""
    new = entries if ledger is None else entries.join(ledger.select("blob", "rule_version").distinct(), ["blob", "rule_version"], "left_anti")
    new.write.mode("append").parquet(path)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, entries): (id, blob) of every row of `versions`, and the ledger rows of this `rule_version` that these
    blobs need, old and new. New entries are those that `ledger` lacks; append them to it."""
    spark = versions.sparkSession
    known = (ledger if ledger is not None else empty_ledger(spark)).where(F.col("rule_version") == rule_version)
    known = known.dropDuplicates(["blob"])
    rows = versions.select(F.col(id_col).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    rows = rows.withColumn("blob", F.sha2(F.col("content").cast("binary"), 256))
    paths = checkpointed(rows.select("path", "blob"))
    blobs = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))
    seen = known.select("blob")
    # Repeated blobs not seen yet, with the path whose row is scanned; blobs seen already are in the filter as well.
    repeated = checkpointed(blobs.where("n > 1").join(seen, "blob", "left_anti").select("blob", "first_path"))
    keys = checkpointed(repeated.select("blob").unionByName(seen).select(F.xxhash64("blob").alias("h")))
    doubt, fresh = parted(rows, F.xxhash64("blob"), keys)
    doubt = doubt.join(seen, "blob", "left_anti").join(repeated, "blob", "left").where("first_path is null or path <=> first_path")
    once = doubt.groupBy("blob").agg(F.first("content").alias("content"))  # repeated rows have one blob and path
    found = fresh.select("blob", "content").unionByName(once).select("blob", scan("content").alias("findings"))
    new = found.select("blob", F.lit(rule_version).alias("rule_version"), "findings")
    needed = known.join(paths.select("blob").distinct(), "blob", "left_semi") if ledger is not None else known
    return paths, needed.unionByName(new)


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, blob, findings) of every row of `versions`."""
    paths, entries = update_ledger(versions, ledger, rule_version, id_col, text)
    hits = checkpointed(entries.where("size(findings) > 0").select("blob", "findings"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return paths.join(hits, "blob", "left").select(F.col("path").alias(id_col), "blob", F.coalesce("findings", none).alias("findings"))


def secret_digest(versions: DataFrame) -> DataFrame:
    """One row per document: base counts, the digest of base spans, and all spans."""
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda kinds: F.array_join(F.transform(F.filter("findings", lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return scan_secrets(versions).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), text(KINDS).alias("spans"))
