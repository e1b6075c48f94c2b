"""A corpus pipeline of five operators: language, near duplicates, benchmark leaks, personal data, mixture.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last adds those of the mixture.  Between stages rows are written as Parquet to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.llm import decontaminate, langid, minhash, mixing, private
from sitequarry.llm.common import load, stored

#: A text is rejected whose best language is hardly likelier than any other of four, or that has no letter.
LEAST_LANGUAGE_SCORE = 0.3
#: Nor one of which less than half of the words are known to any language, however many languages there are.
LEAST_KNOWN = 0.5
#: In production a secret from the caller's vault.
KEY = "corpus-pipeline"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the texts and their languages; texts without a letter, and those that fit no language, go.

    A text is judged by itself: equal ones stay or go together, whatever their other columns are.  A null or empty text goes; a null
    lang teaches nothing and stays.  Nulls elsewhere, repeated rows and further columns are kept as they are.  No rows with a language:
    nothing can be told, and no row stays.
    """
    return langid.accepted(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE, LEAST_KNOWN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, 0.8) the document of least id stays.

    A null text, and one without words, is like no other and stays, also beside others of its kind.  Of rows with one doc_id one stays; rows
    with a null doc_id all stay.  Further columns are kept as they are; no rows give no rows.
    """
    return minhash.deduplicated(docs, words=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat an item of the benchmark go.

    A text is judged by itself, so null and repeated ids don't matter; null and empty texts and items match nothing; repeated rows stay or
    go together.  Further columns are kept as they are; no rows, or no items, change nothing.
    """
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the text, and stays as it was for a null text.

    Every row stays; equal texts stay equal.  Further columns are kept as they are; no rows give no rows.
    """
    out = private.pseudonymised(docs, KEY)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, with n_tokens, pass, block and position in the shuffled stream.

    A null source is a source of its own; a null or empty text has no tokens and goes with its block; repeated rows are used as
    often each.  Columns with the added names are replaced, others kept as they are; no rows give no rows.
    """
    return mixing.mixed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: SQL has no way to express language identification by n-gram backoff; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
