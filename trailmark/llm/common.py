"""Helpers that several operators share: words, checkpoints, and a bounded key filter."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes of UTF-8 text to word bytes: A-Z become a-z, other ASCII but digits and letters becomes a blank.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, as UTF-8; none for a null text."""
    return text.encode("utf-8", "replace").translate(ALNUM_TABLE).split() if text else []


def space_words(text: str | bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, as UTF-8; none for a null text."""
    return (text.encode("utf-8", "replace") if isinstance(text, str) else text).lower().split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder for cut lineage: the one in `spark.checkpoint.dir`. Where a session names none, one of the machine's
    own serves if master is local (a test); on a cluster that is an error, since other machines don't see it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the cluster's shared checkpoint folder and cut from its lineage. Spark removes the files when nothing
    refers to them any more. The result keeps the plan's estimate of size, so loops that join use `Rounds`."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more. It does so when the driver's JVM collects
    garbage, which a driver with memory to spare may put off for long, while the files fill the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Rounds:
    """Tables of a loop, as Parquet below the shared checkpoint folder. Read back, a table has the size of its files as its
    estimate: estimates of joins are products, so those that a checkpoint carries on square with each round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}
        self.folder = f"{checkpoint_folder(spark)}/rounds-{uuid.uuid4().hex}"

    def path(self, name: str, df: DataFrame) -> str:
        """Where `df` is written. The table of this name from two rounds before goes: that of the last round may be in use."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        paths = self.held.setdefault(name, [])
        paths.append(path)
        if len(paths) > 2:
            self._remove(paths.pop(0))
        return path

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """`df` written and read back."""
        return self.spark.read.schema(df.schema).parquet(self.path(name, df))

    def close(self, *keep: str) -> None:
        """Removes all but the last tables of these names."""
        for name, paths in self.held.items():
            while len(paths) > (name in keep):
                self._remove(paths.pop(0))

    def _remove(self, path: str) -> None:
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of `df` as one struct `row`, so that their names can't clash with those of `more` beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[x.alias(name) for name, x in more.items()])


# --- a bounded filter on keys -------------------------------------------------------------------------------------

#: Keys beyond which no filter is built, and a shuffled join alone finds them.
MOST_KEYS = 1 << 22
MOST_BITS = 1 << 24


def bits_for(n_keys: int) -> int:
    """Bits of a filter of so many keys: eight for each at least, up to `MOST_BITS`, a power of two."""
    return min(MOST_BITS, 1 << max(16, (8 * n_keys).bit_length()))


def key_filter(keys: DataFrame, key: str, bits: int = MOST_BITS) -> DataFrame:
    """(kf_word, kf_mask): a one-hash Bloom filter of 64-bit `key`s with `bits` bits, in bits / 64 rows at most.

    `bits` is at most MOST_BITS, so it has at most 262,144 rows and is safe to broadcast at any input size.
    """
    pos = F.pmod(F.col(key), F.lit(bits))
    return (
        keys.where(F.col(key).isNotNull())
        .select(F.shiftright(pos, 6).cast("int").alias("kf_word"), F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))").alias("kf_bit"))
        .groupBy("kf_word")
        .agg(F.bit_or("kf_bit").alias("kf_mask"))
    )


def marked(df: DataFrame, key: Column, filt: DataFrame, name: str, bits: int = MOST_BITS) -> DataFrame:
    """`df` with boolean `name`: false when `key` is surely not in the filter's keys. A null key is false."""
    word = F.shiftright(F.pmod(key, F.lit(bits)), 6).cast("int")
    joined = df.withColumn("kf_key", key).withColumn("kf_at", word)
    joined = joined.join(F.broadcast(filt), F.col("kf_at") == F.col("kf_word"), "left")
    hit = F.expr("coalesce((kf_mask & shiftleft(1L, cast(pmod(kf_key, 64) as int))) != 0, false)")
    return joined.withColumn(name, hit).drop("kf_key", "kf_at", "kf_word", "kf_mask")


def parted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`df` in two parts: rows whose 64-bit `key` may be in `keys` (one column, null-free), and rows whose key surely isn't,
    or is null. Neither is shuffled. Beyond `MOST_KEYS` keys a filter would pass nearly all, so none is built and all rows
    may be in. `keys` is read twice; checkpoint it."""
    n, name = keys.count(), keys.columns[0]
    if n > MOST_KEYS:
        return df, df.where("false")
    bits = bits_for(n)
    found = marked(df, key, key_filter(keys, name, bits), "kf_maybe", bits)
    return found.where("kf_maybe").drop("kf_maybe"), found.where("not kf_maybe").drop("kf_maybe")


def likely_keys(df: DataFrame, on: str, keys: DataFrame) -> DataFrame:
    """Rows of `df` whose `on` is in `keys` (one column of that name), and few others: what a filter of `keys` passes,
    without a shuffle of `df`; beyond `MOST_KEYS` keys exactly the rows, by a shuffled join."""
    if keys.count() > MOST_KEYS:
        return df.join(keys, on, "left_semi")
    return parted(df, F.xxhash64(on), keys.select(F.xxhash64(on)))[0]


def without_keys(df: DataFrame, on: str, keys: DataFrame) -> DataFrame:
    """Rows of `df` whose `on` is null or not in `keys` (one column of that name). Rows that a filter clears aren't shuffled."""
    if keys.count() > MOST_KEYS:
        return df.join(keys, on, "left_anti")
    maybe, rest = parted(df, F.xxhash64(on), keys.select(F.xxhash64(on)))
    return rest.unionByName(maybe.join(keys, on, "left_anti"))
