"""A corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the stages but the last
return the columns of ``documents``. Rejected, repeated and contaminated documents go, personal data are
replaced by their kind, and the last stage returns the tokens of every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import langid, ngram_join, pii_tagger, qgram_filter, sp_tokens
from caseflow.llm.frames import keep, table
from caseflow.llm.queries import language_model


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with calibrated confidence."""
    return langid.keep_identified(docs, language_model(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of linked documents."""
    return ngram_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no region with a benchmark item."""
    return qgram_filter.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), stride=1)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by their kind."""
    return pii_tagger.redact(docs, pii_tagger.fit(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip, n_decoded."""
    return sp_tokens.tokenize(docs, sp_tokens.read_model())


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_benchmark_leaks), ("personal_data", redact_personal_data), ("tokens", tokenize)]

#: Trained models and alignments have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
