"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage but the last returns the columns of ``documents``, whatever further columns these
have and however they are named; an empty table passes through all stages; very long texts are
handled whole.  What the stages do with null and empty texts and with repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import discard, documents, written_alone
from quarryline.llm.exact_dedup import drop_exact_copies
from quarryline.llm.language import accepted, trained
from quarryline.llm.near_dedup import drop_near_copies
from quarryline.llm.packing import packed
from quarryline.llm.pii import redacted

#: Documents whose language has a lower mean probability are rejected; four languages at chance have 0.25.
LEAST_SCORE = 0.3
#: Words that a packing worker remembers, and bytes that it tokenises at once: it stands beside an executor whose heap the earlier stages have grown.
REMEMBERED, PIECE = 50_000, 1 << 18


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null, empty and letterless texts and those without a determined language; repeated rows are judged alike."""
    return accepted(docs, trained(docs), LEAST_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the row with the largest doc_id (a null one is the smallest), one where it repeats; null equals empty."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each class of near copies, the row with the smallest doc_id (null last), one where it repeats; texts without a word are one class."""
    return drop_near_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; ``n_chars`` follows the text; a null text stays null."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids; a null or empty text is its end token alone."""
    return packed(docs, remembered=REMEMBERED, piece=PIECE)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: A trained network, boosted trees and a tokenizer take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables between stages are removed as soon as the next one is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        made = written_alone(lambda: stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = made
    return docs
