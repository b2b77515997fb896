"""Hostile inputs: time in proportion to size, and edges that a review found."""

import collections
import hashlib
import time

import numpy as np
import pytest

from trailmark.llm import decontaminate, exact_dedup, html_text, language_id, license_scan, ngram_join, secret_scan

from .helpers import alnum


def grows_evenly(run, shape, n):
    """Whether twice the input takes about twice the time (the best of three, against noise)."""
    best = lambda x: min(_timed(run, x) for _ in range(3))
    small, large = best(shape(n)), best(shape(2 * n))
    return large < 3.2 * small + 0.05


def _timed(run, x):
    began = time.perf_counter()
    run(x)
    return time.perf_counter() - began


# --- 5 ------------------------------------------------------------------------------------------------------------

HTML = {
    "style without braces": lambda n: "<style>" + "a" * 20 * n + "</style>x",
    "open comments in style": lambda n: "<style>" + "/*" * 10 * n + "</style>x",
    "closed comments in style": lambda n: "<style>" + "/* */p{}" * 2 * n + "</style>x",
    "tags without an end": lambda n: "<a " * 5 * n,
    "quotes without an end": lambda n: '<a x="' * 5 * n,
    "quotes without a pair": lambda n: "<a x='>y" * 2 * n + '<b y=">z',
    "open comments": lambda n: "<!--" * 5 * n,
    "declarations": lambda n: "<![CDATA[" * 5 * n,
    "end tags without an end": lambda n: "</a " * 5 * n,
    "rules of one class": lambda n: "<style>" + ".c{display:block}" * n + "</style>" + "<i class=c>x</i>" * n,
    "many classes": lambda n: "<style>.c1{display:none}</style><i class='" + " ".join(f"c{i % 97}" for i in range(4 * n)) + "'>x</i>",
    "cells over rows": lambda n: "<table>" + "<tr><td rowspan=9>a<td>b" * n + "</table>",
    "cells over all rows": lambda n: "<table><tr>" + "<td rowspan=60000>a" * (n // 50) + "<tr><td>b" * n + "</table>",
    "less than": lambda n: "<" * 20 * n,
    "references": lambda n: "&amp" * 5 * n + "&" * n,
}


@pytest.mark.parametrize("name", sorted(HTML))
def test_pages_take_time_in_proportion(name):
    assert grows_evenly(html_text.render, HTML[name], 8000)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
        ("<table><tr><td>k<td rowspan=3>all<td>1<tr><td>l<td>2<tr><td>m<td>3<tr><td>n<td>o<td>4</table>", "k  all  1\nl       2\nm       3\nn  o    4"),
        ("<table><tr><td rowspan=2 colspan=2>wide<td>x<tr><td>y<tr><td>a<td>b<td>c</table>", "wide  x\n      y\na  b  c"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
        ("a <b x='1' y=\"2>3\" z>c</b> d", "a c d"),
        ("1 < 2 <3 a<b", "1 < 2 <3 a<b"),
        ("x<!-->y<!--->z<!-- a > b -->!<!-- open <p>no", "xyz!"),
        ("<a href='x>seen</a> <p>more", "seen\n\nmore"),
        ("<p>a</p\n>b<br/>c", "a\n\nb\nc"),
        ("<script>if (a</b) x='</scripty>'</script >y", "y"),
        ("<IMG ALT='a &amp; b'><?php no ?>&lt;c&gt;<!DOCTYPE html>", "a & b<c>"),
        ("<style>/* .a{display:none} */ @media print { .b{display:none} } .c , i {display:none}</style><b class=a>1</b><b class=b>2</b><b class=c>3</b><i>4</i>", "1"),
        ("<style>.a{display:none} b.a{display:inline} .a{visibility:hidden}</style><b class=a>1</b><b class=a style='visibility:visible'>2</b>", "2"),
        ("<details><summary>s</summary>inside</details>", "s\ninside"),
        ("<textarea>a &lt; b</textarea>", "a < b"),
    ],
)
def test_scanned_pages(html, want):
    assert html_text.render(html) == want


# --- 9 ------------------------------------------------------------------------------------------------------------

TEXTS = ["eyJ", "eyJabcdefgh", "eyJabcdefgh.", "eyJabcdefgh.eyJ", "token", "token ", "token:", "api_key='", "AKIA", "0123456789abcde ", "0123456789abcdef", "ghp_", "github_pat_", "github_pat_a", "xoxb-", "-----BEGIN ", "-----BEGIN RSA", "-----BEGIN RSA PRIVATE KEY"]


@pytest.mark.parametrize("unit", TEXTS)
def test_patterns_take_time_in_proportion(unit):
    assert grows_evenly(secret_scan.findings, lambda n: unit * (n // len(unit)), 500_000)


def test_tokens_are_found_at_the_start_of_their_run():
    token = "eyJhbGciOiJI.eyJzdWIiOiIx.abcDEF_123-x"
    kinds = lambda text: [(k, text[a:b]) for k, a, b in secret_scan.findings(text) if k == "jwt"]
    assert kinds(f"bearer {token} and ({token})") == [("jwt", token)] * 2
    assert kinds(f"x{token}") == []
    assert kinds("eyJshort.eyJzdWIiOiIx.abcDEF_123") == []


# --- 3 ------------------------------------------------------------------------------------------------------------


def test_letters_of_all_planes(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["the cat sat on the mat and the dog"] * 5)], "doc_id long, text string, lang string")
    filters = language_id.fit(docs)
    for no_letter in ("\U0001f3f4\U000e0067\U000e0062", "\U000e0100", "\U0010fffd", "\U0001f600", "12 !"):
        assert filters.predict(no_letter)[0] == "und"
    assert filters.predict("\U00020000\U00030000")[0] != "und"


def test_parts_of_long_texts_count_like_the_whole(monkeypatch):
    text = "Some words, 1 2 3  and -- more; é" * 40 + "  "
    whole = collections.Counter()
    for size in language_id.SIZES:
        whole.update(language_id.ngrams(language_id.letters(text), size).tolist())
    for piece in (1, 2, 3, 7, 50, 10_000):
        monkeypatch.setattr(language_id, "PIECE", piece)
        parts = collections.Counter()
        for c, old in language_id.lettered(text):
            for size in language_id.SIZES:
                parts.update(language_id.ngrams(c[max(0, old - size + 1) :], size).tolist())
        assert parts == whole


# --- 8 ------------------------------------------------------------------------------------------------------------


def test_windows_of_one_suffix_cost_no_more():
    def search(n):
        patterns = decontaminate.Patterns(tuple([*(b"%d" % (i * 8 + j) for j in range(8)), b"the", b"end"]) for i in range(n))
        words = [b"x"] * 8 + [b"the", b"end"]
        began = time.perf_counter()
        assert list(patterns.search(words * 3000)) == []
        return time.perf_counter() - began

    assert min(search(32_000) for _ in range(3)) < 3 * min(search(1000) for _ in range(3)) + 0.05


# --- 4 ------------------------------------------------------------------------------------------------------------


def test_of_one_id_the_longest_is_kept(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a  b"), (2, "ab"), (3, "c"), (3, "c"), (None, "d"), (None, "d ")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_copies(docs).collect())
    assert got == {(1, 1, 3, True): 1, (1, 1, 3, False): 1, (2, 1, 3, False): 1, (3, 3, 2, True): 2, (None, None, 2, True): 1, (None, None, 2, False): 1}


# --- 6 ------------------------------------------------------------------------------------------------------------


def test_templates_from_a_folder(spark, tmp_path):
    rng = np.random.default_rng(6)
    long = " ".join(f"term{i}" for i in rng.integers(0, 900, 3000))
    (tmp_path / "long-1.0.txt").write_text(long)
    (tmp_path / "short").write_text("do what you like with this file at your own risk")
    (tmp_path / "empty.txt").write_text(" \n")
    templates = license_scan.read_templates(spark, str(tmp_path))
    assert [label for label, _ in templates] == ["long-1.0", "short"]
    worn = [w for i, w in enumerate(alnum(long)) if i % 40]
    texts = {1: "x " * 501 + " ".join(worn) + " y" * 700, 2: "Do what YOU like with this file, at your own risk!", 3: long[:400], 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["row"]["doc_id"]: {b["label"] for b in r["blocks"]} for r in license_scan.find_licenses(docs, templates=templates).collect()}
    assert found == {1: {"long-1.0"}, 2: {"short"}, 3: set(), 4: set()}
    table = spark.createDataFrame([("a", "x y"), (None, "z"), ("b", None)], "label string, text string")
    assert license_scan.templates_of(table) == [("a", "x y")]
    with pytest.raises(ValueError, match="characters"):
        license_scan.templates_of(table.selectExpr("label", "repeat('word ', 20000000) AS text"))


# --- 7 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [1 << 30, 0])
def test_components_of_a_long_path_and_a_star(spark, few):
    path = [(i + 1, i) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(50)]
    links = spark.createDataFrame([*path, *star, (5, 5), (2000, 2001), (2001, 2000)], "a long, b long").repartition(3)
    found = ngram_join.components(links, few)
    want = {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1051)} | {2000: 2000, 2001: 2000}
    assert {r["node"]: r["comp"] for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
    assert {r["node"]: r["root"] for r in ngram_join.roots(spark.createDataFrame(path, "a long, b long")).collect()} == {i: 0 for i in range(301)}


def test_digests_of_kept_rows(spark):
    got = exact_dedup.exact_copies(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), digest=True).collect()
    assert {r["doc_id"]: r["text_sha256"] for r in got} == {1: hashlib.sha256(b"ab").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
