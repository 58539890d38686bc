"""The corpus pipeline: five stages over ``documents``, each of which works on all that the one before it kept.

Defined for every stage: an empty table stays empty; a null or empty text, a null id, repeated rows and texts of any
length are rows like any other, with the result told at the stage; all columns of the table are kept with their own
values, also those named like a result of the stage's operator (the last stage returns its own columns). A column named
``__own_`` and a number is not allowed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import chosen_path, decontaminate, language_id, line_dedup, piece_codec
from weft.llm.arrowtext import cut, small_batches, table
from weft.llm.queries import tokenizer_path

#: A margin between the two best codewords below this is no decision.
UNDECIDED = 0.05


def beside_own_columns(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], *added: str) -> Callable[[str], DataFrame]:
    """Rows of the operator's result that a condition keeps, with the table's own columns: those that clash are renamed meanwhile."""
    away = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c in added}
    found = operator(docs.withColumnsRenamed(away))
    back = [F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns]
    return lambda condition: found.where(condition).select(*back)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; others (null or empty text, no letters, or two codewords alike) go.

    Copies of a row go or stay together. Where no row has a language to learn from, no language can be rejected,
    and all rows stay.
    """
    model = language_id.learn(docs)
    if model is None:
        return docs
    told = beside_own_columns(docs, lambda d: language_id.identify(d, model, ambiguous_below=UNDECIDED), "lang_pred", "score", "margin", "ambiguous")
    return told((F.col("lang_pred") != language_id.UNDETERMINED) & ~F.col("ambiguous"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; a document stays with what is left of it, and goes if no word is left.

    Null and empty texts lose no line and stay. Rows with equal id and text lose the same lines.
    """
    left = beside_own_columns(docs, lambda d: line_dedup.drop_repeated(d, report=True), "n_lines_dropped")
    return left((F.col("n_lines_dropped") == 0) | F.col("text").rlike(r"[^ \t-\r]"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by id (nulls last) of each group of near copies; of repeated rows one stays.

    Documents without words (null, empty, punctuation) are nobody's copies and stay.
    """
    return chosen_path.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. Those without words have none and stay, as all do if the benchmark is empty."""
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return beside_own_columns(docs, lambda d: decontaminate.find_passages(d, table(spark, sf_dir, "benchmark")), *added)("NOT contaminated")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and the digests of each document's ids and decoded text; a null text is the empty one, with no ids."""
    return piece_codec.with_digests(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """Whole texts are long, so that a stage reads few of them at once."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", in_small_batches(identify_language)),
    ("line_dedup", in_small_batches(drop_repeated_lines)),
    ("ngram_jaccard", in_small_batches(keep_one_of_near_copies)),
    ("decontamination", in_small_batches(drop_benchmark_passages)),
    ("sentencepiece", in_small_batches(encode_pieces)),
]

#: The language model, the sampled paths and the merges of the tokenizer can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written before the next begins, so that it can be lost and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
