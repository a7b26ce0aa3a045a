"""Pipeline over a collection: language, near duplicates, benchmark passages, personal data, mixing rates.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept;
``run`` applies them to the documents table. All stages but the last return its columns.

Defined for every stage: other columns, of whatever names, are carried along by all but the last;
rows that repeat an id are told apart by their texts and are each judged by their own; null ids stay
null; an empty table gives an empty result. What becomes of null and empty texts is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.decontaminate import decontaminate
from lexmill.llm.exchange import name
from lexmill.llm.language_id import fit, identified
from lexmill.llm.mixing import TARGETS, label_domain, mix
from lexmill.llm.near_dup import near_dup
from lexmill.llm.pii import redact
from lexmill.llm.scratch import scratch


def _table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _wide(docs: DataFrame) -> DataFrame:
    """(d, i, t): the row as a struct, so that its columns can't clash with a stage's own; its id and the hash of its text."""
    return docs.select(F.struct(*map(name, docs.columns)).alias("d"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"))


def _marked(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """The rows that are (left_semi) or aren't (left_anti) among ``marks`` (doc_id, tie)."""
    m = marks.select(F.col("doc_id").alias("marked_id"), F.col("tie").alias("marked_tie"))
    return rows.join(m, F.col("i").eqNullSafe(F.col("marked_id")) & (F.col("t") == F.col("marked_tie")), how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language (null, empty and letterless texts); lang becomes the prediction.

    Texts with letters all stay and get the nearest learned language, however low its score; null languages are predicted too.
    """
    model = fit(docs, "text", "lang", "doc_id")
    known = identified(docs, model).where("lang_pred <> 'und'")
    return known.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col("d").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five words, 0.8): the smallest id, null ids last.

    Of rows equal in id and text one stays. Documents without words (null, empty and all-space texts) are
    linked with nothing and all stay.
    """
    marks = scratch(near_dup(docs, shingle=5, percent=80).select("doc_id", "tie", "group"), "marks")
    grouped, wordless = marks.where("group is not null"), marks.where("group is null")
    best = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("b")).select("b.doc_id", "b.tie")
    left = _marked(_wide(docs), best.unionByName(wordless.select("doc_id", "tie")), "left_semi")
    if not grouped.groupBy("doc_id", "tie").count().where("count > 1").isEmpty():
        # equal rows: one of each that has words stays (the same rows as without this step if there are none)
        left = _marked(left, best, "left_semi").dropDuplicates(["i", "t"]).unionByName(_marked(left, wordless, "left_semi"))
    return left.select("d.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; null and empty texts hold none and stay."""
    marks = scratch(decontaminate(docs, _table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "tie"), "marks")
    if marks.count() <= 1_000_000:  # else the texts are shuffled to meet them
        marks = F.broadcast(marks)
    return _marked(_wide(docs), marks, "left_anti").select("d.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows. Null texts stay null, with n_chars null."""
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else name(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, posteriors and the rate at which to draw each document; null and empty texts have 0 tokens and the rate of their posterior."""
    return mix(docs, _table(spark, sf_dir, "labels"), label_domain(), TARGETS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for k, (stage, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(docs, stage)
    return docs


#: The stages hold trained models, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None
