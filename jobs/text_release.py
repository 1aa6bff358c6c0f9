"""A training release of text records in splits that copies can't leak across.

Records whose texts are equal after lower-casing A-Z and joining white space are one group, named by the fingerprint of that text; whole
groups go to ``test`` or one of the folds. Labels are attached where there are any. Records without a word have nothing to train on and
are counted, not released.

Writes ``records/split=/lang=`` (Parquet with the whole texts), ``counts`` (JSON: rows, groups, characters and labelled rows per split and
language) and refuses to publish if a group occurs in two splits. A rerun replaces both and gives the same rows.

    python -m jobs.text_release --documents IN --labels IN --output OUT [--config FILE]
"""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.joins import left_attributes
from rasterloom.operators.splits import split_leaks, splits_of_groups

log = logging.getLogger("jobs.text_release")


def text_groups(texts: pd.Series) -> pd.Series:
    """Of UTF-8 texts, with A-Z in lower case, one space between words and none around them, the first 12 hexadecimal digits of the MD5; None
    without a word. Of bytes, ``lower`` takes A-Z alone and ``split`` cuts at 0x20 and 0x09 to 0x0D alone."""
    plain = (b" ".join(x.lower().split()) if x is not None else b"" for x in texts)
    return pd.Series([hashlib.md5(x, usedforsecurity=False).hexdigest()[:12] if x else None for x in plain], dtype=object)


def grouped(documents: DataFrame) -> DataFrame:
    """Records with a word, with their group."""
    named = F.pandas_udf(text_groups, "string").asNondeterministic()  # else the filter would ask a second time
    return documents.withColumn("text_group", named(F.col("text").cast("binary"))).where(F.col("text_group").isNotNull())


def attached(records: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Of labels given twice the largest counts."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    return left_attributes(records, one, "doc_id")


def release_texts(spark: SparkSession, documents_path: str, labels_path: str, output: str, config: dict) -> DataFrame:
    """Writes the release and returns its records as written."""
    documents, labels = spark.read.parquet(documents_path), spark.read.parquet(labels_path)
    texts = grouped(documents)
    groups = texts.select("text_group").distinct().persist()  # their ranks take two looks; texts are read for the groups once
    records = texts.join(splits_of_groups(groups, "text_group", config["test_share"], config["folds"]), "text_group")
    whole = attached(records, labels, config["label_columns"]).select("doc_id", "text", "source", "n_chars", "text_group", *config["label_columns"], "split", "lang")
    here = f"{output}/records"
    try:
        whole.hint("rebalance", "split", "lang").write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy("split", "lang").parquet(here)
    finally:
        groups.unpersist()

    written = spark.read.schema(whole.schema).parquet(here)
    worst = split_leaks(written, "text_group").first()["max_splits"]
    if (worst or 1) > 1:
        raise RuntimeError(f"a group of equal texts occurs in {worst} splits")
    labelled = F.coalesce(*(F.col(c) for c in config["label_columns"])).isNotNull()
    counts = written.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("text_group").alias("n_groups"), F.sum("n_chars").alias("n_chars"), F.count_if(labelled).alias("n_labelled"))
    counts.coalesce(1).write.mode("overwrite").json(f"{output}/counts")
    n_read, n_kept = documents.count(), written.count()
    log.info("read %d documents of %s, wrote %d to %s, left out %d without a word", n_read, documents_path, n_kept, here, n_read - n_kept)
    return written


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "labels", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=os.path.splitext(os.path.abspath(__file__))[0] + ".json")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("text-release").getOrCreate()
    try:
        release_texts(spark, args.documents, args.labels, args.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
