"""Operator 13, chat formatting, by assembly of tokens.

A conversation becomes `<s>`, then its turns: `[SYS]text[/SYS]`, `[INST]text[/INST]` for a user, `text</s>` for an assistant,
`[ROLE]role[/ROLE]text</s>` for any other role. Each segment (a text, or the name of another role) is encoded by itself with a
public vocabulary; the control strings are never encoded but spliced in as ids above the vocabulary. So a segment's tokens
don't depend on its neighbours, and no text can make a control id.

Control strings in a segment are escaped, so that the formatted text too reads back unambiguously: after the opening bracket of a
control string they hold one backslash more than in the text (`<s>` becomes `<\\s>`, `<\\s>` becomes `<\\\\s>`). Two such
strings never overlap, since each ends at the first bracket after its own, so taking one backslash off again restores the text.

Tokens are placed by prefix sums: of the pieces' lengths for their starts, and of +1 and -1 at the ends of assistant texts for
the loss mask. The mask holds assistant texts and no control id.

Scale: texts are encoded where they are read, whatever their conversation, so a conversation that holds many rows doesn't
gather the work of encoding. Rows are then dealt by conversation and sorted, and a stream cuts them into parts of about
`PART` tokens between turns; `start` is a part's place in its conversation. Memory is bounded by a batch of rows and by a part
(or one turn, if longer). `read_back` is a stream too.

Nulls: a null text is empty, a null role is an empty one, which is a role of its own. Rows of a null conversation are one
conversation. Rows go by turn, nulls first; rows of one turn by role and text, repeated rows each count. A very long text is cut
into runs of `RUN` code points for the encoder, whose time grows with the square of a run without blanks. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import load_encoding

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Control strings (fixed values); their ids follow the vocabulary in this order.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
BOS, EOS, INST, INST_END, SYS, SYS_END, ROLE, ROLE_END = range(8)
#: What opens and closes a turn of these roles; others go by ROLE.
FRAMES = {"system": ((SYS,), SYS_END), "user": ((INST,), INST_END), "assistant": ((), EOS)}
LEARNED = "assistant"
PART = 1 << 16
RUN = 1 << 14

_CONTROL = re.compile(r"<(\\*/?s)>|\[(\\*/?(?:INST|SYS|ROLE))\]")
_ESCAPED = re.compile(r"<\\(\\*/?s)>|\[\\(\\*/?(?:INST|SYS|ROLE))\]")

FORMATTED = "conv_id long, part int, start long, n_turns int, ids array<int>, loss array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: f"<\\{m[1]}>" if m[1] is not None else f"[\\{m[2]}]", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}>" if m[1] is not None else f"[{m[2]}]", text)


class Codec:
    """Text to ids and back. Control i has the id `base` + i."""

    def __init__(self, vocabulary: str):
        self.encoding = load_encoding(vocabulary)
        self.base = self.encoding.max_token_value + 1

    def encode(self, text: str) -> list[int]:
        text = escaped(text)
        if len(text) <= RUN:
            return self.encoding.encode_ordinary(text)
        return [i for start in range(0, len(text), RUN) for i in self.encoding.encode_ordinary(text[start : start + RUN])]

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")

    def render(self, ids: list[int]) -> str:
        """The formatted text of any ids."""
        out, at = [], 0
        for i in [*np.flatnonzero(np.asarray(ids) >= self.base).tolist(), len(ids)]:
            out.append(self.decode(ids[at:i]))
            out += [CONTROLS[ids[i] - self.base]] if i < len(ids) else []
            at = i + 1
        return "".join(out)


def encoded(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, turn, role, digest, role_ids, text_ids) of rows (conv_id, turn, role, text), with nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            role_ids = pa.array([None if r in FRAMES else codec.encode(r) for r in roles], pa.list_(pa.int32()))
            text_ids = pa.array([codec.encode(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), batch.column("digest"), role_ids, text_ids], names=["conv_id", "turn", "role", "digest", "role_ids", "text_ids"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, digest binary, role_ids array<int>, text_ids array<int>")


def assembled(pieces: list[np.ndarray], learned: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces and the mask of learned ones, by prefix sums."""
    ends = np.cumsum([len(p) for p in pieces])
    step = np.zeros(int(ends[-1]) + 1, np.int32)
    mark = np.asarray(learned)
    np.add.at(step, (ends - [len(p) for p in pieces])[mark], 1)
    np.add.at(step, ends[mark], -1)
    return np.concatenate(pieces).astype(np.int32), np.cumsum(step)[:-1] > 0


def formatted(turns: DataFrame, vocabulary: str = VOCABULARY, part: int = PART) -> DataFrame:
    """`FORMATTED`: rows (conv_id, turn, role, text) as token ids with their loss mask, in parts of about `part` tokens in the
    order of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = load_encoding(vocabulary).max_token_value + 1
        control = [np.array([base + i], np.int32) for i in range(len(CONTROLS))]
        conv, number, start, n_turns, size = None, 0, 0, 0, 0
        pieces, learned, rows = [], [], []

        def close() -> None:
            nonlocal number, start, n_turns, size
            if pieces:
                ids, loss = assembled(pieces, learned)
                rows.append((conv[0], number, start, n_turns, ids, loss))
                number, start, n_turns, size = number + 1, start + len(ids), 0, 0
                pieces.clear()
                learned.clear()

        def put(ids: np.ndarray, learn: bool = False) -> None:
            nonlocal size
            pieces.append(ids)
            learned.append(learn)
            size += len(ids)

        def batch_of() -> pa.RecordBatch:
            facts = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32()))]
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[i]) for r in rows)]), pa.int32()), pa.array(np.concatenate([r[i] for r in rows]))) for i in (4, 5)]
            out = pa.RecordBatch.from_arrays([*facts, *lists], names=["conv_id", "part", "start", "n_turns", "ids", "loss"])
            rows.clear()
            return out

        for batch in batches:
            convs, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
            for i, (key, role) in enumerate(zip(convs, roles, strict=True)):
                if conv is None or conv[0] != key:
                    close()
                    conv, number, start = (key,), 0, 0
                    put(control[BOS])
                elif size >= part:
                    close()
                opens, end = FRAMES.get(role, ((ROLE,), EOS))
                for c in opens:
                    put(control[c])
                if role not in FRAMES:
                    put(batch.column("role_ids")[i].values.to_numpy())
                    put(control[ROLE_END])
                put(batch.column("text_ids")[i].values.to_numpy(), role == LEARNED)
                put(control[end])
                n_turns += 1
            if sum(len(r[4]) for r in rows) >= part:
                yield batch_of()
        close()
        if rows:
            yield batch_of()

    order = [F.asc_nulls_first("turn"), "role", "digest"]
    rows = encoded(turns, vocabulary).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)
    return rows.select("conv_id", "role", "role_ids", "text_ids").mapInArrow(run, FORMATTED)


def read_turns(ids: list[int], codec: Codec) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in the ids of a part."""
    base, by_open = codec.base, {SYS: "system", INST: "user"}
    role, at = LEARNED, 0
    for i in np.flatnonzero(np.asarray(ids) >= base).tolist():
        kind = ids[i] - base
        if kind in (SYS, INST):
            role = by_open[kind]
        elif kind == ROLE_END:
            role = unescaped(codec.decode(ids[at:i]))
        elif kind in (SYS_END, INST_END, EOS):
            yield role, unescaped(codec.decode(ids[at:i]))
            role = LEARNED
        at = i + 1


def learned_texts(ids: list[int], loss: list[bool], codec: Codec) -> Iterator[str]:
    """The texts under the mask, a run each, unescaped."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(loss, np.int8), [0]])))
    for a, b in edges.reshape(-1, 2).tolist():
        yield unescaped(codec.decode(ids[a:b]))


def read_back(parts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`DIGESTS` of each conversation in `FORMATTED` rows, from their ids and masks alone: turns as role, line feed, text, line
    feed, and the texts under the mask, each hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, conv, rows = Codec(vocabulary), None, []
        n, turns, chars, loss, size = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        for batch in batches:
            for key, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss")), strict=True):
                if conv is None or conv[0] != key:
                    rows += [(*conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)] if conv else []
                    conv, n, turns, chars, loss, size = (key,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, text in read_turns(ids, codec):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for text in learned_texts(ids, mask, codec):
                    chars += len(text)
                    loss.update(text.encode())
                size += len(codec.render(ids))
            if rows:
                yield digests(rows)
                rows = []
        if conv:
            yield digests([(*conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)])

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in DIGESTS.split(", ")])

    rows = parts.select("conv_id", "part", "ids", "loss").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part")
    return rows.select("conv_id", "ids", "loss").mapInArrow(run, DIGESTS)
