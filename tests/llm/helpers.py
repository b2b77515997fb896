"""Small documents with everything that may go wrong, and brute-force versions."""

import collections
import itertools

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, xd_len int, keep_id long, topic string"
LONG = " ".join(f"word{i} the of" for i in range(60_000))


def nasty(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and clashing column names."""
    rows = [
        (1, "The cat sat on the mat and the dog lay by the door all day long", "en", "a"),
        (2, "The  cat sat on the mat and the dog lay by the door all day long", "en", "a"),
        (2, "The  cat sat on the mat and the dog lay by the door all day long", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n", "fr", "b"),
        (None, "Le chat est sur la table et le chien est devant la porte de la maison", "fr", "b"),
        (6, "Le chat est sur la table et le chien est devant la porte de la maison", None, "b"),
        (7, LONG, "en", None),
        (8, "12345 67890 !!! ???", "en", "b"),
        (9, "ÀÉÎ ßtraße 日本語 😀 \u0000 end", "fr", "c"),
        (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "own", 7, -1, -2, "mine") for r in rows], SCHEMA)


def words(text):
    """White-space words after lower-casing A-Z."""
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out, word = [], ""
    for c in (text or "").translate(up):
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def alnum(text):
    """Runs of ASCII digits, letters and non-ASCII characters after lower-casing A-Z."""
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c > "\x7f" or "0" <= c <= "9" or "a" <= c <= "z":
            word += c
        else:
            if word:
                out.append(word)
            word = ""
    return out + [word] if word else out


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(docs, k, percent):
    """{id: (size of its set, smallest id that its links reach)} for (id, text) pairs, comparing all pairs of sets."""
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_set = collections.defaultdict(list)
    for i, s in sets.items():
        if s:
            by_set[s].append(i)
    for group in by_set.values():
        for i in group[1:]:
            a, b = sorted((root(group[0]), root(i)))
            parent[b] = a
    for x, y in itertools.combinations(by_set, 2):
        same = len(x & y)
        if same and 100 * same >= percent * (len(x) + len(y) - same):
            a, b = sorted((root(by_set[x][0]), root(by_set[y][0])))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}
