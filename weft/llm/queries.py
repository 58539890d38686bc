"""Queries of this subpackage, each over its whole table, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import chosen_path, decontaminate, host_consensus, language_id, line_dedup, piece_codec, quality_rules, subword_quality, toxicity, url_cascade
from weft.llm import labels as label_sample
from weft.llm.arrowtext import crc32_mod, table


def tokenizer_path() -> str:
    """The public merge-type model; the operator itself takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    out = quality_rules.apply_policy(quality_rules.apply_policy(entries, "base@1", "base_kept"), "prose@1", "kept")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "fail_bits"
    )


def op2_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 3) == 1
    model = language_id.learn(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "ambiguous")


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


def op4_piece_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.with_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 4) == 2
    rows = label_sample.sample(docs, table(spark, sf_dir, "labels"), "quality", ~held_out, {0: subword_quality.PER_CLASS, 1: subword_quality.PER_CLASS}, subword_quality.SAMPLE_BYTES)
    model = subword_quality.fit([x for x, _ in rows], [y for _, y in rows])
    return subword_quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_consensus.extract_pages(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 5) == 0
    rows = label_sample.sample(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out, {0: toxicity.CLEAN_TEXTS, 1: toxicity.TOXIC_TEXTS}, toxicity.SAMPLE_BYTES)
    model = toxicity.fit([x for x, _ in rows], [y for _, y in rows])
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.judge(pages, url_cascade.hosts_with_words(pages)).drop("url")


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join_ngrams(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM rep, (SELECT unnest(range(5)) AS k)) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')))::BIGINT AS n_upper,
    (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::BIGINT AS n_marks
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_upper > 4 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_marks > 5 * n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

OP8_SQL = """
WITH r AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[.-])(WORDS)([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM v
""".replace("WORDS", "|".join(url_cascade.LISTED_WORDS))

OP10_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i+n-1], ' ') AS g
  FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
win AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM pat) WHERE len(ws) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM win JOIN pat USING (n, g)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_codes": op2_language_codes,
    "op3_line_runs": op3_line_runs,
    "op4_piece_prefixes": op4_piece_prefixes,
    "op5_subword_quality": op5_subword_quality,
    "op6_host_consensus": op6_host_consensus,
    "op7_toxicity": op7_toxicity,
    "op8_url_cascade": op8_url_cascade,
    "op9_chosen_path": op9_chosen_path,
    "op10_passages": op10_passages,
}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op8_url_cascade": OP8_SQL, "op10_passages": OP10_SQL}
