"""Operator 6, license scans, by an exact set-similarity join of text blocks with license templates.

Blocks are runs of `BLOCK` words, one every `STRIDE`, so that any run of STRIDE words lies within one. For a template of
more words both are doubled until the stride has as many, so that a run as long as the template always lies within one
of its blocks, wherever it starts. A block matches a
template when it contains at least `THRESHOLD` of the template's distinct tokens. Template tokens are ordered by their
document frequency over the whole table, rare ones first. Three filters leave few blocks to compare, and lose none:

* prefix: with a least overlap of o = ceil(THRESHOLD * |T|), a block that matches T holds one of T's first |T| - o + 1
  tokens in that order; blocks that hold no prefix token of any template are never looked at;
* length: the block has at least o distinct template tokens;
* position: the tokens that remain on both sides after the first shared one still allow o.

Frequencies are counted in one pass, with one partial row per token and task; the templates and their frequencies are
configuration, so they fit anywhere. Matching is another pass without a shuffle. A very long text is cut in blocks, in
time linear in its words. Python gets texts in Arrow batches of at most 64 MB, and a longer text alone.

Templates are single lines of notices and whole notices. A line has few words, so that nearly all must be there, in any
order, within a block; in a whole notice a twelfth of the distinct words may be missing or replaced. Whole license texts come
from a folder (`read_templates`) or a table (`templates_of`), of any length and number up to a size, beside or instead of these.
Of tokens that are equally frequent the one that is less in bytes comes first.

The base search counts the places where the words of a fixed phrase stand consecutively; its labels always stay.

Nulls: a null text counts as empty, with no words, places or labels. Repeated rows are reported each. A label found by a
base phrase has score 1; otherwise the score is the largest containment among matches, 0 without any. An empty table
gives an empty result. Input columns travel in a struct, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words

BLOCK, STRIDE, THRESHOLD = 64, 32, 0.92
#: Characters of all templates, about those of the two thousand longest public licenses.
MOST_CHARS = 50_000_000
# Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Lines of public license notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


# Whole notices.
NOTICES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
)


def read_templates(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(label, text) of the files in a folder of license texts, each named by its label."""
    files = spark.read.option("wholetext", True).text(folder).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(\.[^.]*)?$", 1).alias("label"), F.col("value").alias("text"))
    return templates_of(files)


def templates_of(table: DataFrame, label: str = "label", text: str = "text") -> list[tuple[str, str]]:
    """(label, text) of a table of license texts: configuration, of `MOST_CHARS` characters at most (an error beyond). Null or
    wordless texts are left out."""
    rows = table.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).where("label is not null and text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MOST_CHARS:
        raise ValueError(f"the templates have {size} characters; at most {MOST_CHARS} are taken")
    return [(r["label"], r["text"]) for r in rows.orderBy("label", "text").collect() if alnum_words(r["text"])]


def stride_of(n_words: int) -> int:
    """The stride of the blocks for a template of so many words, at least as long as it."""
    stride = STRIDE
    while stride < n_words:
        stride *= 2
    return stride


def token_frequencies(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Documents that hold each token of the vocabulary; at most one row for each token comes back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch["t"]:
                found.update(vocabulary.intersection(alnum_words(t)))
        yield pd.DataFrame({"token": [t.decode() for t in found], "n": list(found.values())}).astype({"token": "object", "n": "int64"})

    rows = docs.select(F.col(text).alias("t")).mapInPandas(count, "token string, n long")
    return {r["token"].encode(): r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Templates by stride of their blocks and prefix token, in the global order."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        sets = [(label, set(alnum_words(t)), stride_of(len(alnum_words(t)))) for label, t in templates]
        tokens = sorted(set().union(*[s for _, s, _ in sets]), key=lambda t: (frequency.get(t, 0), t))
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.by_stride: dict[int, dict[bytes, list]] = {}
        for label, s, stride in sets:
            by_token = self.by_stride.setdefault(stride, defaultdict(list))
            least = -int(-threshold * len(s) // 1)
            ordered = sorted(s, key=self.rank.get)
            for i, t in enumerate(ordered[: len(s) - least + 1]):
                by_token[t].append((label, s, least, i))
        self.prefix = frozenset().union(*self.by_stride.values())

    def matches(self, words: list[bytes]) -> list[tuple[int, str, float]]:
        """(start of the block, label, containment) of every matching block and template."""
        if self.prefix.isdisjoint(words):
            return []
        found = []
        for stride, by_token in self.by_stride.items():
            found += self._matches(words, stride, by_token)
        return found

    def _matches(self, words: list[bytes], stride: int, by_token: dict[bytes, list]) -> list[tuple[int, str, float]]:
        length = BLOCK // STRIDE * stride
        near = [i for i, w in enumerate(words) if w in by_token]
        starts = sorted({s for i in near for s in range(max(0, (i - length) // stride + 1) * stride, i + 1, stride) if s == 0 or s + stride < len(words)})
        found = []
        for start in starts:
            block = sorted({w for w in words[start : start + length] if w in self.rank}, key=self.rank.get)
            seen = set()
            for j, token in enumerate(block):
                for label, template, least, i in by_token.get(token, ()):
                    if id(template) in seen:
                        continue
                    seen.add(id(template))  # later shared tokens bound it no better than this first one
                    if len(block) < least or 1 + min(len(template) - i, len(block) - j) - 1 < least:
                        continue
                    same = len(template.intersection(block))
                    if same >= least:
                        found.append((start, label, same / len(template)))
        return found


def places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, int, str]]:
    """(first word, end word, label) of every place where a phrase's words stand consecutively."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases:
        needle = f" {phrase} ".encode()
        at, last, start = line.find(needle), 0, 0
        while at >= 0:
            start += line.count(b" ", last, at)
            found.append((start, start + phrase.count(" ") + 1, label))
            last, at = at, line.find(needle, at + 1)
    return sorted(found)


def find_licenses(docs: DataFrame, text: str = "text", templates=TEMPLATES + NOTICES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` packed as struct `row`, with `n_words`, `places` (start, end, label of each base phrase) and `blocks`
    (start, label, containment of each matching block)."""
    vocabulary = frozenset(w for _, t in templates for w in alnum_words(t))
    index = Index(templates, token_frequencies(docs, text, vocabulary), threshold)

    @F.pandas_udf("n_words long, places array<struct<start:long,end:long,label:string>>, blocks array<struct<start:long,label:string,containment:double>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                words = alnum_words(t)
                base = [{"start": a, "end": b, "label": x} for a, b, x in places(words, phrases)]
                out.append((len(words), base, [{"start": a, "label": x, "containment": c} for a, x, c in index.matches(words)]))
            yield pd.DataFrame(out, columns=["n_words", "places", "blocks"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("ls_text"))
    return packed.select("row", search("ls_text").alias("f")).select("row", "f.*")


def license_digest(docs: DataFrame) -> DataFrame:
    found = find_licenses(docs.select("doc_id", "text"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base = F.col("places.label")
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("blocks.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.round(F.array_max("blocks.containment"), 6), F.lit(0.0))).alias("score"),
    )
