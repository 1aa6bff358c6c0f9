"""The jobs as registered queries: each runs twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

import json
import os
import string
import uuid

from pyspark.sql import DataFrame, SparkSession

from rasterloom.plans.lineage import shared_folder

from .observation_ingest import ingest_observations
from .text_release import release_texts


def _config(name: str) -> dict:
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as f:
        return json.load(f)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_observation_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table may be one file or a folder of files, which a glob takes both."""
    out = _folder(spark, "observation-ingest")
    for _ in range(2):
        summary = ingest_observations(spark, f"{sf_dir}/events.parquet*", out, f"{out}/checkpoint", _config("observation_ingest"))
    return summary


def job2_text_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "text-release")
    for _ in range(2):
        records = release_texts(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, _config("text_release"))
    return records


def _ingest_sql() -> str:
    c = _config("observation_ingest")
    types = ", ".join(f"'{t}'" for t in c["types"])
    return f"""WITH p AS (SELECT event_id, ts, user_id, coalesce(event_type, 'unknown') AS event_type, CASE WHEN isnan(value) THEN NULL ELSE value END AS value, try_cast(props->>'$.{c["property"]}' AS DOUBLE) AS property, coalesce(strftime(ts, '%Y-%m-%d'), 'none') AS day FROM events),
f AS (SELECT *, event_id IS NULL OR ts IS NULL OR event_type NOT IN ({types}) OR coalesce(value NOT BETWEEN {c["value_range"][0]} AND {c["value_range"][1]}, TRUE) OR coalesce(property NOT BETWEEN {c["property_range"][0]} AND {c["property_range"][1]}, TRUE) AS rejected FROM p)
SELECT day, event_type, count(*) AS n, count(*) FILTER (rejected) AS n_rejected, count(DISTINCT user_id) AS n_groups, round(avg(value) FILTER (NOT rejected), 6) AS value_mean, round(quantile_cont(value, 0.5) FILTER (NOT rejected), 6) AS value_median, round(quantile_cont(value, 0.95) FILTER (NOT rejected), 6) AS value_p95 FROM f GROUP BY day, event_type"""


def _release_sql() -> str:
    c = _config("text_release")
    labels = c["label_columns"]
    return rf"""WITH p AS (SELECT *, trim(regexp_replace(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain FROM documents),
g AS (SELECT doc_id, text, source, n_chars, lang, substr(md5(plain), 1, 12) AS text_group FROM p WHERE plain <> ''),
r AS (SELECT text_group, row_number() OVER (ORDER BY md5(text_group), text_group) - 1 AS place, round_even(count(*) OVER () * {c["test_share"]}, 0) AS cut FROM (SELECT DISTINCT text_group FROM g)),
s AS (SELECT text_group, CASE WHEN place < cut THEN 'test' ELSE 'fold' || ((place - cut) % {c["folds"]})::INT END AS split FROM r),
l AS (SELECT doc_id, {", ".join(f"max({x}) AS {x}" for x in labels)} FROM labels GROUP BY doc_id)
SELECT g.doc_id, g.text, g.source, g.n_chars, g.text_group, {", ".join(f"l.{x}" for x in labels)}, s.split, g.lang FROM g JOIN s USING (text_group) LEFT JOIN l ON l.doc_id = g.doc_id"""


QUERIES = [job1_observation_ingest, job2_text_release]
SQL = {"job1_observation_ingest": _ingest_sql(), "job2_text_release": _release_sql()}
