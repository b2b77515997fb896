"""Queries over the driver's tables, one for each operator, and the SQL that restates those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, hard_negatives, html_text, language_id, license_scan, mixing, ngram_join, secret_scan, structure_repair, token_counts, url_filter
from .common import LOWER, UPPER, alnum_words, read_table


#: Exponents of the token shares that op1 and the pipeline aim for: flatter sources and languages, topics as they are.
MIX_ALPHA = {"source": 0.5, "lang": 0.7, "topic": 1.0}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), MIX_ALPHA, columns=["doc_id"])
    return mixed.select("row.doc_id", "topic", "n_tokens", "weight", "rate", "copies")


def op2_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_suffix_sums(token_counts.length_histogram(read_table(spark, sf_dir, "documents")))


def op3_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    test = language_id.held_out()
    filters = language_id.fit(docs.where(~test))
    found = language_id.identify(docs.select("doc_id", test.alias("held_out"), "text"), filters)
    return found.select("row.doc_id", "row.held_out", "lang_pred", F.col("score").cast("double").alias("score"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(read_table(spark, sf_dir, "documents"), digest=True)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.visible_text(read_table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", "visible_text", F.length("visible_text").cast("long").alias("n_chars"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(read_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(read_table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(read_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repaired(structure_repair.damaged(read_table(spark, sf_dir, "conversations")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)


#: A conversation that op13 formats beside those of the table (fixed values).
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.formatted(turns.unionByName(more)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_token_histogram": op2_token_histogram,
    "op3_language_filters": op3_language_filters,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_html_text": op5_html_text,
    "op6_license_scan": op6_license_scan,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_decontamination": op8_decontamination,
    "op9_secret_ledger": op9_secret_ledger,
    "op10_url_filter": op10_url_filter,
    "op11_structure_repair": op11_structure_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat_format": op13_chat_format,
}


def _mixing_sql(sweeps: int = mixing.SWEEPS) -> str:
    """The fitting of op1, one table for each scaling step."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(body, '{p}') THEN '{name}'" for name, p in mixing.TOPICS) + f" ELSE '{mixing.OTHER}' END"
    steps = ["w0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / (SELECT sum(tokens) FROM cells) AS w FROM cells)"]
    for i in range(3 * sweeps):
        d = mixing.DIMENSIONS[i % 3]
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN m > 0 THEN w * share / m ELSE 0 END AS w FROM w{i} JOIN (SELECT {d}, sum(w) AS m FROM w{i} GROUP BY {d}) USING ({d}) JOIN goal_{d} USING ({d}))")
    goals = [
        f"goal_{d} AS MATERIALIZED (SELECT {d}, share / sum(share) OVER () AS share FROM (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {MIX_ALPHA[d]}) ELSE 0 END AS share FROM cells GROUP BY {d}))"
        for d in mixing.DIMENSIONS
    ]
    return rf"""
        WITH docs AS MATERIALIZED (
          SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, {topic} AS topic,
            len(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
          FROM (SELECT *, coalesce(text, '') AS body FROM documents)),
        cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
        {", ".join(goals + steps)},
        rates AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END * (SELECT sum(tokens) FROM cells), 6) AS rate FROM w{3 * sweeps})
        SELECT doc_id, topic, n_tokens, rate AS weight, rate,
          (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || doc_id), 1, 8))::UBIGINT / 4294967296.0 < round(rate - floor(rate), 6) THEN 1 ELSE 0 END)::BIGINT AS copies
        FROM docs JOIN rates USING (source, lang, topic)"""


def _license_sql() -> str:
    """op6 without its filters: every block against every template of its length."""
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    stride = lambda t: license_scan.stride_of(len(alnum_words(t)))
    all_templates = license_scan.TEMPLATES + license_scan.NOTICES
    templates = ", ".join(f"({i}, '{label}', {stride(t)}, {quoted(sorted(set(alnum_words(t))))})" for i, (label, t) in enumerate(all_templates))
    strides = ", ".join(f"({s})" for s in sorted({stride(t) for _, t in all_templates}))
    phrases = ", ".join(f"('{label}', {quoted(alnum_words(p))})" for p, label in license_scan.PHRASES)
    times = license_scan.BLOCK // license_scan.STRIDE
    return rf"""
        WITH docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        phrases(label, p) AS (VALUES {phrases}), templates(id, label, stride, t) AS (VALUES {templates}), strides(stride) AS (VALUES {strides}),
        spots AS (SELECT doc_id, label, i - 1 AS start FROM (SELECT doc_id, w, label, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM docs, phrases) WHERE w[i : i + len(p) - 1] = p),
        base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM spots GROUP BY doc_id),
        blocks AS (SELECT doc_id, stride, list_distinct(w[i + 1 : i + {times} * stride]) AS b FROM (SELECT doc_id, w, stride, unnest(range(0, greatest(1, len(w) - stride), stride)) AS i FROM docs, strides)),
        found AS (SELECT doc_id, label, len(list_intersect(b, t)) / len(t) AS c FROM blocks JOIN templates USING (stride) WHERE len(list_intersect(b, t)) >= ceil({license_scan.THRESHOLD} * len(t))),
        named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM spots) GROUP BY doc_id),
        base_named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM spots) GROUP BY doc_id),
        best AS (SELECT doc_id, round(max(c), 6) AS c FROM found GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
          coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
        FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN base_named USING (doc_id) LEFT JOIN best USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": _mixing_sql(),
    "op6_license_scan": _license_sql(),
    "op4_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
          FROM documents),
        k AS (SELECT h, count(*) AS size, arg_min(doc_id, struct_pack(a := -points, b := doc_id)) AS keep FROM n GROUP BY h)
        SELECT doc_id, keep AS keep_id, size AS group_size, doc_id = keep AS kept, h AS text_sha256 FROM n JOIN k USING (h)""",
    "op8_decontamination": r"""
        WITH docs AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
        wins AS (
          SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g
          FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
        lens AS (SELECT DISTINCT m FROM wins),
        grams AS (
          SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
          FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, lens WHERE len(w) >= m)),
        hits AS (SELECT doc_id, i, grams.m, item_id FROM grams JOIN wins ON grams.m = wins.m AND grams.g = wins.g),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
          sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_hard_negatives": """
        WITH vectors AS MATERIALIZED (
          SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        positives AS MATERIALIZED (
          SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label, a.v, p.r AS positive, p.vec_id AS positive_id, list_dot_product(a.v, p.v)::BIGINT AS positive_score
          FROM vectors a JOIN vectors p ON a.label = p.label AND a.r <> p.r WHERE a.vec_id % 100 = 0
          QUALIFY row_number() OVER (PARTITION BY a.r ORDER BY positive_score DESC, p.vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor, positive ORDER BY negative_score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, negative_score
        FROM (SELECT p.*, n.vec_id, list_dot_product(p.v, n.v)::BIGINT AS negative_score FROM positives p JOIN vectors n ON n.label <> p.label)
        WHERE 80 * positive_score <= 100 * negative_score AND negative_score <= positive_score
        QUALIFY rank <= 5""",
    "op13_chat_format": r"""
        WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
        sized AS (
          SELECT *, sha256(text) AS digest, len(regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(INST|SYS|ROLE)\])', '[\\\1', 'g')) AS chars,
            CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 17 + len(regexp_replace(regexp_replace(role, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(INST|SYS|ROLE)\])', '[\\\1', 'g')) END AS frame
          FROM turns)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, digest)) AS turns_sha256,
          coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, digest) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          (3 + sum(chars + frame))::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
}
