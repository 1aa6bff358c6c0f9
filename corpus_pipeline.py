"""The corpus pipeline: five stages from raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import Workspace, made_by, table
from rasterloom.llm.exact_dedup import drop_exact_duplicates
from rasterloom.llm.ngram_join import drop_near_duplicates
from rasterloom.llm.packing import pack_documents
from rasterloom.llm.quality_classifier import keep_by_quality
from rasterloom.llm.quality_rules import keep_by_rules


#: Near copies share this much of their sets of shingles of so many words; the thin query has its own contract.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained classifier scores at least 0.5. Null and empty texts are scored like others; equal rows get equal
    verdicts; without labels of two kinds all rows share one verdict; extra columns stay; an empty table stays empty."""
    return keep_by_quality(spark, docs, table(spark, sf_dir, "labels"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and their group's fences. Null and empty texts go; null lang or source are groups of their own;
    equal rows get equal verdicts; extra columns stay; an empty table stays empty."""
    return keep_by_rules(spark, docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest doc_id (null ids are least, of equal ids one row). Null counts as empty;
    extra columns stay; an empty table stays empty."""
    return drop_exact_duplicates(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id (null ids last). Null and empty texts and those of white
    space only are nobody's copies; extra columns stay; an empty table stays empty."""
    return drop_near_duplicates(spark, docs, NEAR_WORDS, NEAR_PERCENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, columns as in ``pack_documents``. A null or empty text is one end-of-document id; rows of equal or null doc_id are
    packed apart; extra columns are ignored; an empty table gives no piece."""
    return pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("packing", pack_sequences),
]

#: Trained models, tokenisers and iterated joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again.

    What a stage wrote on its way is freed when its own result has been written, and that result when the next one has been; the last one stays.
    """
    work, before = Workspace(spark, "corpus-pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with made_by() as made:
            docs = work.write(stage(spark, docs, sf_dir), name)
        for w in made:
            w.drop()
        if before:
            work.drop(before)
        before = name
    return docs
