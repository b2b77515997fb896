"""Operators 11 to 13 on small inputs: brute force, round trips, and what must not crash."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from tests.helpers import assert_same, duck
from trailmark.llm import chat_format, hard_negatives, structure_repair
from trailmark.llm.queries import CONTROL_TURNS, ORACLE_SQL, QUERIES

BLANK = " \t\n\x0b\x0c\r"
EXTRA = ", digest string, audit string, gone int, symbols string, part int"
MORE = ("x", "y", 5, "z", 9)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


# --- 11 structure repair ------------------------------------------------------------------------------------------


def damage_by_hand(rows):
    """conv_id to its rows (turn, role, text) after damage, in order."""
    out = {c: [] for c, *_ in rows}
    text = lambda v: " " if v is None else str(v)
    for c, turn, role, body in rows:
        kind = zlib.crc32(f"{text(c)}:{text(turn)}".encode()) % 20
        role, body = text(role), text(body)
        if kind == 0:
            continue
        body = "" if kind == 1 else body.translate({ord(x): None for x in ".!?"}) if kind == 2 else body
        role = "user" if kind == 4 else role
        out[c] += [(turn, role, body)] * (2 if kind == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(v, key=key) for c, v in out.items()}


def faults_by_hand(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANK)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    return out


def accepted(roles):
    initials = "".join(r[:1] or "-" for r in roles)
    rest = initials[1:] if initials[:1] == "s" else initials
    return not initials or (rest and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def forward(rows, faults):
    """(cost, audit, repaired rows) by carrying the best edits of every state over the rows."""
    nexts = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}

    def offer(held, state, cand):
        if state not in held or cand[:2] < held[state][:2]:
            held[state] = cand

    def inserted(held):
        held = dict(held)
        for _ in range(3):
            for state, (cost, audit, made) in list(held.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in nexts:
                        offer(held, nexts[state, role[0]], (cost + 3, audit + "I", (*made, (role, ""))))
        return held

    for (_, role, text), fault in zip(rows, faults, strict=True):
        held = {}
        for state, (cost, audit, made) in inserted(best).items():
            offer(held, state, (cost + 4, audit + "D", made))
            if fault not in ("blank", "duplicate"):
                for new, letter, more in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    if (state, new[:1]) in nexts:
                        offer(held, nexts[state, new[:1]], (cost + more + 3 * (fault == "truncated"), audit + letter, (*made, (new, text))))
        best = held
    ends = [v for state, v in inserted(best).items() if state in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def every_edit(rows, faults, most_inserted=4):
    """(cost, audit) by trying all edits."""
    best = None
    options = []
    for (_, role, text), fault in zip(rows, faults, strict=True):
        cut = 3 * (fault == "truncated")
        stay = [] if fault in ("blank", "duplicate") else [("K", cut, role), ("R", 3 + cut, "user"), ("R", 3 + cut, "assistant")]
        options.append([("D", 4, None), *stay])
    for picks in itertools.product(*options):
        for places in itertools.product(range(3), repeat=len(rows) + 1):
            if sum(places) > most_inserted:
                continue
            for roles in itertools.product(("user", "assistant"), repeat=sum(places)):
                it, out, audit, cost = iter(roles), [], "", 0
                for i, n in enumerate(places):
                    out += [next(it) for _ in range(n)]
                    audit += "I" * n
                    cost += 3 * n
                    if i < len(rows):
                        letter, more, role = picks[i]
                        audit, cost = audit + letter, cost + more
                        out += [role] if role is not None else []
                if accepted(out) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def repaired_by_hand(rows):
    out = {}
    for conv, turns in damage_by_hand(rows).items():
        faults = faults_by_hand(turns)
        cost, audit, made = forward(turns, faults)
        assert accepted([r for r, _ in made])
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        count = collections.Counter(faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, *MORE) for r in rows], "conv_id long, turn long, role string, text string" + EXTRA)
    got = structure_repair.repaired(structure_repair.damaged(df)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_forward_like_every_edit():
    rng = random.Random(11)
    for _ in range(60):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["ok.", "cut", "", "two."])) for i in range(rng.randrange(0, 4))]
        faults = faults_by_hand(rows)
        assert forward(rows, faults)[:2] == every_edit(rows, faults)


def test_grammar_like_forward():
    """Any grammar gives the cheapest and least edits, also of long sequences."""
    rng = random.Random(5)
    letters = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in [*range(12), 40, 300]:
        s = "".join(rng.choice("sSuuUaaAoOd") for _ in range(n))
        rules, packed = [], s
        for _ in range(5):
            pairs = structure_repair.apart(collections.Counter(map("".join, itertools.pairwise(packed))).most_common(4))
            for pair in pairs:
                packed = packed.replace(pair, chr(structure_repair.FIRST_RULE + len(rules)))
                rules.append(pair)
        faults = ["blank" if c == "d" else "truncated" if c.isupper() else "" for c in s]
        rows = [(0, letters.get(c.lower(), "user"), "") for c in s]
        assert structure_repair.Grammar(rules).cheapest(packed) == forward(rows, faults)[:2]
        assert structure_repair.Grammar([]).cheapest(s) == forward(rows, faults)[:2]


def test_long_sequences_end():
    s = "uaUsaodu" * 20_000
    grammar = structure_repair.Grammar(["ua", "Us", "ao", "du", "一丁", "丂七", "丄丅"])
    packed = s.replace("uaUsaodu", chr(structure_repair.FIRST_RULE + 6))
    cost, audit = grammar.cheapest(packed)
    assert len(audit) - audit.count("I") == len(s) and cost > 0


def test_pairs_do_not_overlap():
    chosen = structure_repair.apart([("ab", 9), ("bc", 8), ("cc", 7), ("ad", 6), ("ea", 5), ("ce", 4)])
    assert chosen == ["ab", "cc", "ad"]


def test_repair_like_by_hand(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_structure_repair"](spark, sf_dir).collect()}
    assert got == repaired_by_hand(rows)


def test_repair_of_random_conversations(spark):
    rng = random.Random(2)
    rows = [
        (c, rng.choice([None, t, t + 2, 3]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "unicorn", "", None]), rng.choice(["Yes.", "No!", "so", " ", "", None, "ends. \n", "é?"]))
        for c in [*range(150), None]
        for t in range(rng.randrange(1, 12))
    ]
    assert repaired(spark, rows) == repaired_by_hand(rows)


def test_repair_edges(spark):
    long = "word " * 300_000
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 0, "user", long), (2, None, None, None), (3, 2, "assistant", "Hi."), *[(4, t, "ua"[t % 2] + "x", f"{t}.") for t in range(400)]]
    assert repaired(spark, rows) == repaired_by_hand(rows)
    assert repaired(spark, []) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(dropped, 0, "user", "Gone.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# --- 12 hard negatives --------------------------------------------------------------------------------------------


def mined_by_hand(rows, is_anchor, n_pos=5, n_neg=5, scale=256):
    part = [(i, y, [int(np.floor(np.float64(scale) * x)) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda x: (-x[1], x[0] is None, x[0] or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for at, (i, y, v) in enumerate(part):
        if i is None or not is_anchor(i):
            continue
        scored = [(j, dot(v, w), z) for k, (j, z, w) in enumerate(part) if k != at]
        for p, s, _ in sorted((x for x in scored if x[2] == y), key=key)[:n_pos]:
            negatives = sorted((x for x in scored if x[2] != y and 80 * s <= 100 * x[1] <= 100 * s), key=key)[:n_neg]
            out += [(i, p, r, n, s, t) for r, (n, t, _) in enumerate(negatives, 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=3):
    df = spark.createDataFrame([(*r, 1, "x", -5) for r in rows], "vec_id long, label int, embedding array<double>, anchor int, v string, score int")
    return sorted(map(tuple, hard_negatives.hard_negatives(df, df["vec_id"] % every == 0).collect()), key=str)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_chat_format"])
def test_query_matches_sql(name, spark, sf_dir, con):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], con)


@pytest.mark.parametrize("seed", [1, 2])
def test_mining_like_all_pairs(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(6)] + 0.3 * rng.normal(size=5)).round(2).tolist()) for i in range(400)]
    rows += rows[:30] + [(i, 1, rows[0][2]) for i in range(900, 960)]
    want = mined_by_hand(rows, lambda i: i % 3 == 0)
    for tree, anchors, block in ((2048, 8192, 1024), (7, 40, 16), (1, 60, 50)):
        monkeypatch.setattr(hard_negatives, "TREE", tree)
        monkeypatch.setattr(hard_negatives, "PASS_ANCHORS", anchors)
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        assert mined(spark, rows) == want


def test_bounds_spare_scores():
    rng = np.random.default_rng(4)
    anchors = np.floor(256 * (np.array([3.0, 0, 0, 0]) + 0.05 * rng.normal(size=(200, 4))))
    order, parents, edges = hard_negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(200)) and (parents[1:] < np.arange(1, 200)).all() and parents[0] == -1
    tree = hard_negatives.Tree(0, parents.tolist(), edges.tolist(), anchors[order], (anchors[order] ** 2).sum(axis=1))
    lo = np.full((200, 1), 2 * 65536)
    asked = hard_negatives.Pass([tree], list(range(200)), ["a"] * 200, True, 3, lo, np.full((200, 1), 1 << 62), [])
    flat = np.floor(256 * rng.normal(size=(500, 4))).ravel()
    x = hard_negatives.Vectors(np.arange(500), np.zeros(500, bool), ["a"] * 500, np.full(500, 4), (flat.reshape(500, 4) ** 2).sum(axis=1), flat, np.arange(0, 2000, 4))
    best = hard_negatives.Best(asked)
    done = hard_negatives.scan_block(x, slice(0, 500), asked, best, {"a": 0}, [0] * 200)
    assert done < 0.35 * 500 * 200
    exact = flat.reshape(500, 4) @ anchors[order].T
    for a in range(200):
        want = sorted((-int(s), False, i) for i, s in enumerate(exact[:, a]) if s >= 2 * 65536)[:3]
        assert best.rows.get((a, 0), []) == want


def test_mining_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (3, 1, [1.0]), (6, 2, []), (9, None, [1.0]), (12, 1, None), (15, 1, [nan, 1.0]), (18, 2, [inf]), (21, 2, [None, 1.0])]
    rows += [(24, 2, [0.9, 1.9, 5.0]), (27, 2, [1.0, 2.0]), (None, 2, [1.0, 1.9]), (None, 1, [1.0, 1.8]), (30, -3, [-1.0, -2.0]), (33, 3, [2e6, 1e6]), (36, 3, [2e6, 1e6]), (39, 4, [1.9e6, 1e6]), (42, 5, [0.001] * 50_000)]
    assert mined(spark, rows) == mined_by_hand(rows, lambda i: i % 3 == 0)
    huge = [(0, 1, [1e300]), (3, 1, [1.0]), (6, 1, [1.0]), (1, 2, [0.9])]
    assert mined(spark, huge) == mined_by_hand(huge[1:], lambda i: i % 3 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []


# --- 13 chat formatting -------------------------------------------------------------------------------------------


def digests_by_hand(rows):
    held = collections.defaultdict(list)
    for c, turn, role, text in rows:
        held[c].append((turn, role or "", text or ""))
    out = {}
    for c, turns in held.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        said = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


NASTY = ["<s>", "</s>", "<\\s>", "<\\\\/s>", "[INST]", "[/\\INST]", "[\\/INST]", "<<s>>", "[[INST]]", "<", "\\", "s>", "\\s>", "a", "é", "😀", "日本", "\n", " ", "[ROLE", "]", "[SYS]", "<S>", "\u0000"]


def test_escapes_are_undone():
    rng = random.Random(13)
    for _ in range(4000):
        text = "".join(rng.choice(NASTY) for _ in range(rng.randrange(0, 9)))
        held = chat_format.escaped(text)
        assert chat_format.unescaped(held) == text
        assert not any(c in held for c in chat_format.CONTROLS)


def formatted(spark, rows, part=chat_format.PART):
    df = spark.createDataFrame([(*r, *MORE) for r in rows], "conv_id long, turn long, role string, text string" + EXTRA)
    return chat_format.formatted(df, part=part)


def test_formatted_reads_back(spark):
    rng = random.Random(3)
    some = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randrange(0, 6)))
    rows = [(c, rng.choice([None, t, 2]), rng.choice(["system", "user", "assistant", "tool", some(), None]), rng.choice([some(), None])) for c in [*range(60), None] for t in range(rng.randrange(1, 9))]
    rows += [(-7, *r[1:]) for r in CONTROL_TURNS] + [(500, 0, "assistant", "x" * 200_000), (500, 1, "assistant", " " * 100_000), (500, 2, "user", "é[INST]" * 30_000)]
    want = digests_by_hand(rows)
    for part in (chat_format.PART, 5):
        parts = formatted(spark, rows, part)
        got = {r["conv_id"]: tuple(r)[1:] for r in chat_format.read_back(parts).collect()}
        assert {c: v[:4] for c, v in got.items()} == want
        codec, whole = chat_format.Codec(chat_format.VOCABULARY), collections.defaultdict(list)
        for r in parts.orderBy("conv_id", "part").collect():
            assert r["start"] == len(whole[r["conv_id"]]) and len(r["ids"]) == len(r["loss"])
            whole[r["conv_id"]] += r["ids"]
        assert {c: len(codec.render(ids)) for c, ids in whole.items()} == {c: v[4] for c, v in got.items()}


def test_formatted_text_and_mask(spark):
    rows = [(1, 0, "system", "Be </s> brief"), (1, 1, "user", "Hi"), (1, 2, "assistant", "Yo [INST]"), (1, 3, "tool", "42")]
    r = formatted(spark, rows).first()
    codec = chat_format.Codec(chat_format.VOCABULARY)
    assert codec.render(r["ids"]) == "<s>[SYS]Be <\\/s> brief[/SYS][INST]Hi[/INST]Yo [\\INST]</s>[ROLE]tool[/ROLE]42</s>"
    assert codec.decode([i for i, m in zip(r["ids"], r["loss"], strict=True) if m]) == "Yo [\\INST]"
    assert r["n_turns"] == 4 and r["part"] == 0


def test_format_edges(spark):
    assert formatted(spark, []).count() == 0 and chat_format.read_back(formatted(spark, [])).count() == 0
    empty = {r["conv_id"]: tuple(r)[1:] for r in chat_format.read_back(formatted(spark, [(1, 0, "assistant", None), (1, 1, "assistant", "")])).collect()}
    assert empty[1][:4] == digests_by_hand([(1, 0, "assistant", None), (1, 1, "assistant", "")])[1]
