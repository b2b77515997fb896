"""Operator 11, conversation structure repair, by dynamic programming over a grammar.

A conversation is the sequence of its rows' role and fault, one symbol each: role initial (s, u, a or other) and whether the text
is cut short, or that the row must go (a blank text, or role and text seen earlier). The cheapest edits that bring the role
initials into the form (s?(ua)+)? are wanted: keep 0, change the role to user or assistant 3, delete 4, insert an empty user
or assistant row 3, and 3 for a row that stays though it is cut short. Of equally cheap edits, those whose initials (D, I, K, R in
order) are least in ASCII.

1. What stands so far is one of four states: nothing, after s, after u, after a. A symbol is a min-plus matrix of 4 x 4:
   the cheapest way from state to state over that row, insertions before it included, as a cost and an audit rope. Matrices
   compose: of two equally cheap audits over the same rows neither begins the other (it would have to differ by insertions, which
   cost), so the least audit of a whole is made of least audits of its parts.
2. Equal sequences are one. Re-Pair over all distinct sequences replaces frequent neighbours by new symbols, some pairs that don't
   overlap each round, until no pair occurs twice or there are `MAX_RULES` rules.
3. A rule's matrix is the product of those of its two symbols, made once per task and only if a sequence holds it,
   bottom-up, and shared by all sequences. A rope holds its two halves, its length and hash, so that products copy no text, and two
   audits are compared by descending to the first difference.
4. Remaining symbols of a sequence are multiplied as a balanced tree. The audit fixes the roles: an odd number of rows begins
   with s. A stream of each conversation's rows and its audit writes the repaired rows' digest.

Scale: rows are dealt by conversation without texts, sorted and streamed; the sequence that a task holds for a conversation
is as long as the audit that the result holds anyway. Sequences are counted before they meet the grammar, so copies of one
conversation cost one. Rounds of Re-Pair send the driver at most `PER_ROUND` pairs, and the grammar is bounded by MAX_RULES; it
only speeds the work, any grammar gives the same result. Texts are dealt by conversation once, for the digest, which is a
sequence by nature. Memory is bounded by a batch and an audit.

Nulls: a null role or text is one space; a null turn comes first and counts in no gap; rows of a null conversation are one
conversation. Rows of one turn go by role and then by the text's SHA-256. Repeated rows are duplicates. An empty role has no
initial and can't be kept. An empty table gives an empty result. Other columns are ignored. Very long texts are read whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rounds, checkpointed
from .exact_dedup import BLANKS

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Symbols: a row that must go, then role initials whole and cut short.
GONE, WHOLE, SHORT = "d", "suao", "SUAO"
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Where the initials s, u and a lead.
STEPS = {"s": {NOTHING: AFTER_S}, "u": {NOTHING: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
MAX_RULES = 1024
PER_ROUND = 64
MAX_ROUNDS = 16
FIRST_RULE = 0x4E00


# --- damage and faults --------------------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) of `turns` after the damage that crc32 of `conv_id:turn` modulo 20 names: 0 drops the
    row (gone), 1 empties its text, 2 removes stops, 3 repeats it, 4 makes its role user. Null roles and texts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, gone, fault, symbol, initial) of rows in `damaged`'s form: the first fault of each row."""
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    rows = rows.withColumn("end", F.when(F.col("gone"), "").otherwise(end)).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = rows.select("conv_id", "turn", F.when(F.col("gone"), "").otherwise(F.col("role")).alias("role"), "digest", "gone", "end").repartition("conv_id")
    seen = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    fault = F.when(F.col("gone"), "gone").when(F.col("end") == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin(*"sua"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return rows.withColumn("fault", fault).select("conv_id", "turn", "role", "digest", "fault", symbol.alias("symbol"), initial.alias("initial"))


def sequences(faults: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, symbols) of every conversation, streamed in order."""
    names = ("blank", "duplicate", "truncated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rows = None, []

        def start(key: int | None) -> None:
            nonlocal conv, counts, symbols, illegal, last, turns
            conv, counts, symbols, illegal, last, turns = (key,), dict.fromkeys(names, 0), [], 0, None, [None, None, 0]

        def close() -> None:
            first, greatest, distinct = turns
            gaps = greatest - first + 1 - distinct if distinct else 0
            rows.append((conv[0], gaps, *counts.values(), illegal, "".join(symbols)))

        def told() -> pa.RecordBatch:
            types = [*[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "gaps", *names, "illegal", "symbols"])

        counts, symbols, illegal, last, turns = {}, [], 0, None, [None, None, 0]
        for batch in batches:
            for key, turn, fault, symbol, initial in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "fault", "symbol", "initial")), strict=True):
                if conv is None or conv[0] != key:
                    if conv:
                        close()
                    start(key)
                if fault == "gone":
                    continue
                if fault:
                    counts[fault] += 1
                symbols.append(symbol)
                illegal += last is not None and last + initial not in ("su", "ua", "au")
                last = initial
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            if rows:
                yield told()
                rows = []
        if conv:
            close()
            yield told()

    rows = faults.sortWithinPartitions(*order()).select("conv_id", "turn", "fault", "symbol", "initial")
    return rows.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, symbols string")


# --- Re-Pair ------------------------------------------------------------------------------------------------------


def frequent_pairs(packed: DataFrame) -> list[tuple[str, int]]:
    """The most frequent neighbours in all sequences (packed), at most PER_ROUND, that occur twice or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for batch in batches:
            for s in batch["packed"]:
                found.update(map("".join, zip(s, s[1:], strict=False)))
        yield pd.DataFrame({"pair": list(found), "n": list(found.values())}).astype({"pair": "str", "n": "int64"})

    counted = packed.select("packed").mapInPandas(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
    return [(r["pair"], r["n"]) for r in counted.orderBy(F.desc("n"), "pair").limit(PER_ROUND).collect()]


def apart(pairs: list[tuple[str, int]]) -> list[str]:
    """Of pairs, most frequent first, those that can't overlap: no symbol ends one and begins another, or the same."""
    chosen, begin, end = [], set(), set()
    for pair, _ in pairs:
        twin = pair[0] == pair[1]
        if pair[0] in end or pair[1] in begin or (twin and (pair[0] in begin | end)):
            continue
        chosen.append(pair)
        begin.add(pair[0])
        end.add(pair[1])
    return chosen


def re_pair(distinct: DataFrame, max_rules: int = MAX_RULES) -> tuple[DataFrame, list[str]]:
    """(symbols, packed) of distinct sequences (symbols), and the grammar: rule i, chr(FIRST_RULE + i), stands for two symbols."""
    rounds, rules = Rounds(distinct.sparkSession), []
    packed = rounds.put("packed", distinct.select("symbols", F.col("symbols").alias("packed")))
    for _ in range(MAX_ROUNDS):
        pairs = apart(frequent_pairs(packed))[: max_rules - len(rules)]
        if not pairs:
            break
        replaced = F.col("packed")
        for i, pair in enumerate(pairs, len(rules)):
            replaced = F.replace(replaced, F.lit(pair), F.lit(chr(FIRST_RULE + i)))
        rules += pairs
        packed = rounds.put("packed", packed.select("symbols", replaced.alias("packed")))
    rounds.close("packed")
    return packed, rules


# --- ropes and matrices -------------------------------------------------------------------------------------------

PRIME, BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """A text of letters held as two halves, with its length and hash."""

    __slots__ = ("hash", "left", "letter", "n", "power", "right")

    def __init__(self, left: Rope | None = None, right: Rope | None = None, letter: str = ""):
        self.left, self.right, self.letter = left, right, letter
        if left is None or right is None:
            self.n, self.hash, self.power = len(letter), ord(letter) if letter else 0, BASE if letter else 1
        else:
            self.n = left.n + right.n
            self.hash = (left.hash * right.power + right.hash) % PRIME
            self.power = left.power * right.power % PRIME

    def __add__(self, other: Rope) -> Rope:
        return self if not other.n else other if not self.n else Rope(self, other)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x.n == y.n and x.hash == y.hash:
                continue
            if x.n == y.n == 1:
                return x.letter < y.letter
            if x.n >= y.n:
                a += [x.right, x.left]
                b.append(y)
            else:
                a.append(x)
                b += [y.right, y.left]
        return bool(b)

    def __str__(self) -> str:
        out, open_ = [], [self]
        while open_:
            x = open_.pop()
            if x.left is None:
                out.append(x.letter)
            else:
                open_ += [x.right, x.left]
        return "".join(out)


EMPTY = Rope()
LETTERS = {c: Rope(letter=c) for c in "DIKR"}
#: From state to state: (cost, audit) of the cheapest way, or None.
Matrix = list[list[tuple[int, Rope] | None]]


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    if a is None or b is None:
        return b if a is None else a
    return a if a[0] < b[0] or (a[0] == b[0] and not b[1] < a[1]) else b


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        held = []
        for j in range(4):
            best = None
            for k in range(4):
                x, y = row[k], b[k][j]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    best = better(best, (x[0] + y[0], x[1] + y[1]))
            held.append(best)
        out.append(held)
    return out


@functools.cache
def insertions() -> Matrix:
    """Any number of insertions; more than two lead nowhere new."""
    one: Matrix = [[(0, EMPTY) if i == j else None for j in range(4)] for i in range(4)]
    for initial in "ua":
        for i, j in STEPS[initial].items():
            one[i][j] = better(one[i][j], (INSERT, LETTERS["I"]))
    return times(one, times(one, one))


@functools.cache
def base_matrix(symbol: str) -> Matrix:
    """Insertions, then what may be done with the row."""
    row: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        row[i][i] = (DELETE, LETTERS["D"])
    if symbol != GONE:
        more = CUT if symbol in SHORT else 0
        for initial, letter, cost in ((symbol.lower(), "K", KEEP), ("u", "R", REROLE), ("a", "R", REROLE)):
            for i, j in STEPS.get(initial, {}).items():
                row[i][j] = better(row[i][j], (cost + more, LETTERS[letter]))
    return times(insertions(), row)


class Grammar:
    """Matrices of symbols, each made when first asked for, from those below it."""

    def __init__(self, rules: list[str]):
        self.rules, self.made = rules, {}

    def matrix(self, symbol: str) -> Matrix:
        open_ = [symbol]
        while open_:
            at = open_[-1]
            if at in self.made:
                open_.pop()
            elif (rule := ord(at) - FIRST_RULE) < 0:
                self.made[at] = base_matrix(at)
            elif missing := [x for x in self.rules[rule] if x not in self.made]:
                open_ += missing
            else:
                self.made[at] = times(*(self.made[x] for x in self.rules[rule]))
        return self.made[symbol]

    def cheapest(self, packed: str) -> tuple[int, str]:
        """Cost and audit of the best edits of a sequence."""
        level = [self.matrix(x) for x in packed]
        while len(level) > 1:
            level = [times(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        whole = times(level[0], insertions()) if level else insertions()
        cost, audit = better(whole[NOTHING][NOTHING], whole[NOTHING][AFTER_A])
        return cost, str(audit)


def audits(packed: DataFrame, rules: list[str]) -> DataFrame:
    """(symbols, cost, audit) of each sequence (symbols, packed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(rules)
        for batch in batches:
            found = [grammar.cheapest(p) for p in batch["packed"]]
            yield pd.DataFrame({"symbols": batch["symbols"], "cost": [c for c, _ in found], "audit": [a for _, a in found]})

    return packed.mapInPandas(run, "symbols string, cost long, audit string")


# --- repair -------------------------------------------------------------------------------------------------------


class Repair:
    """Repaired rows (role, text), in order, of the rows that `take` gets one after another."""

    def __init__(self, audit: str):
        rows = len(audit) - audit.count("D")
        self.audit, self.at, self.out, self.system = audit, 0, 0, rows % 2

    def _role(self) -> str:
        """The role that form asks of the next row."""
        role = ("user", "assistant")[(self.out - self.system) % 2]
        self.out += 1
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._role(), ""

    def take(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            asked = self._role()
            yield role if edit == "K" else asked, text


def with_repairs(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`found` (conv_id, audit and other columns of numbers) with repaired_sha256: `rows` in `damaged`'s form are streamed behind
    their conversation's row."""
    facts = [c for c in found.columns if c not in ("conv_id", "audit")]
    schema = T.StructType([*found.select("conv_id", *facts, "audit").schema, T.StructField("repaired_sha256", T.StringType())])
    types = [*[pa.int64()] * (len(facts) + 1), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, repair, digest, n, out = None, None, None, 0, []

        def put(made: Iterator[tuple[str, str]]) -> None:
            nonlocal n
            for role, text in made:
                digest.update(("\n" * (n > 0) + f"{role}:{text}").encode())
                n += 1

        def close() -> None:
            put(repair.inserted())
            out.append((*head, digest.hexdigest()))

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

        for batch in batches:
            for *first, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *facts, "audit", "role", "text")), strict=True):
                if audit is None:
                    put(repair.take(role, text))
                    continue
                if head:
                    close()
                head, repair, digest, n = (*first, audit), Repair(audit), hashlib.sha256(), 0
            if out:
                yield told()
                out = []
        if head:
            close()
            yield told()

    texts = rows.where("not gone").select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    both = texts.unionByName(found, allowMissingColumns=True).repartition("conv_id")
    first, *rest = order()
    both = both.sortWithinPartitions(first, F.col("audit").isNull(), *rest)
    return both.select("conv_id", *facts, "audit", "role", "text").mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of `rows`
    (conv_id, turn, role, text, gone); rows that are `gone` only name their conversation."""
    found = checkpointed(sequences(with_faults(rows)))
    packed, rules = re_pair(checkpointed(found.select("symbols").distinct()))
    return with_repairs(rows, found.join(checkpointed(audits(packed, rules)), "symbols").drop("symbols"))
