"""The pipeline's stages against brute-force versions, each on its own input."""

import re

import pytest

import corpus_pipeline
from trailmark.llm import decontaminate

from .helpers import alnum, components, nasty


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """[(stage, rows in, rows out)] over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.checkpointed(stage(spark, docs, sf_dir))
        found.append((name, docs, out))
        docs = out
    return {name: (a, b) for name, a, b in found}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "decontamination", "source_mixing"]


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name == "source_mixing":
            assert after.columns[: len(before.columns)] == before.columns
        else:
            assert after.columns == before.columns


def test_language_id_keeps_texts_with_letters(stages):
    before, after = map(pairs, stages["language_id"])
    assert sorted(after) == sorted((i, t) for i, t in before if t and any(c.isalpha() for c in t))


def test_language_id_drops_noise_and_other_languages(spark, sf_dir):
    import random

    rng = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(80)) for _ in range(5)]
    other = ["Кошка сидела на коврике", "猫坐在垫子上整天", "1234 !!"]
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise + other)], "doc_id long, text string")
    out = corpus_pipeline.language_id(spark, docs.unionByName(rows, allowMissingColumns=True), sf_dir)
    # Brute force: the same least scores and filters, one text at a time.
    model = corpus_pipeline.calibrated(docs)
    assert 0 < model.least["en"] < 0.7
    want = [(i, t) for i, t in pairs(docs.unionByName(rows, allowMissingColumns=True)) if (p := model.predict(t))[1] > 0 and p[1] >= model.least.get(p[0], 0)]
    assert sorted(pairs(out)) == sorted(want) == sorted((i, t) for i, t in pairs(docs) if t and any(c.isalpha() for c in t))


def test_language_id_keeps_letters_without_labels(spark, sf_dir):
    rows = [(1, "Some text", None), (2, "12 !", None), (3, None, None), (4, "语言", None)]
    out = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), sf_dir)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4]


def test_exact_dedup_keeps_one_of_each(stages):
    before, after = map(pairs, stages["exact_dedup"])
    best = {}
    for i, t in before:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[n] = min(best.get(n, (1, 0)), (-len(t or ""), i))
    assert sorted(i for i, _ in after) == sorted(i for _, i in best.values())


def test_near_copies_keep_one_of_each_component(stages):
    before, after = map(pairs, stages["ngram_jaccard_join"])
    want = components(before, 5, 80)
    assert sorted(i for i, _ in after) == sorted(i for i, (_, c) in want.items() if c == i)


def test_decontamination_drops_what_holds_a_window(stages, spark, sf_dir):
    before, after = map(pairs, stages["decontamination"])
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    windows = {" " + " ".join(w.decode() for w in win) + " " for r in items for win in decontaminate.windows(r["text"])}
    clean = [i for i, t in before if not any(w in " " + " ".join(alnum(t)) + " " for w in windows)]
    assert sorted(i for i, _ in after) == sorted(clean) and len(clean) < len(before)


def test_mixing_draws_from_its_input(stages):
    before, after = stages["source_mixing"]
    ids = {i for i, _ in pairs(before)}
    rows = after.collect()
    assert {r["doc_id"] for r in rows} <= ids and all(r["copies"] >= 1 for r in rows)
    assert len(rows) > len(ids) / 2


def test_run_equals_the_stages(stages, spark, sf_dir):
    got = sorted((r["doc_id"], r["copies"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted((r["doc_id"], r["copies"]) for r in stages["source_mixing"][1].collect())


def test_stages_take_anything(spark, sf_dir):
    for docs in (nasty(spark), nasty(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.checkpointed(stage(spark, docs, sf_dir))
            assert "topic" in docs.columns, name
