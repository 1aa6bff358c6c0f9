"""The two jobs: growing input, repeated deliveries, a failed batch, reruns, and their registered queries against SQL."""

import datetime
import json
import logging
import os
import string
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobs import observation_ingest as ingest
from jobs import queries, text_release

DATA = "/root/testdata/sf0.001"
CONFIG = queries._config("observation_ingest") | {"types": ["a", "b"], "value_range": [0.0, 10.0], "property_range": [0, 5], "files_per_batch": 2}


def rows(day, ids, value=1.0, kind="a", props='{"k": 1}', user=None):
    at = None if day is None else datetime.datetime(2024, 1, day, 12)
    return [(i, at, (user if user is not None else i), kind, value + i if value is not None else None, props) for i in ids]


def deliver(spark, source, found):
    """One more file of the source, as a delivery would bring it."""
    spark.createDataFrame(found, CONFIG["schema"]).coalesce(1).write.mode("append").parquet(source)


def run(spark, folder, config=CONFIG):
    return ingest.ingest_observations(spark, f"{folder}/in", f"{folder}/out", f"{folder}/mark", config)


def shown(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))


def by_day(frame):
    return {(r.day, r.event_type): (r.n, r.n_rejected, r.n_groups, r.value_mean, r.value_median, r.value_p95) for r in frame.collect()}


def test_growing_input_takes_only_what_is_new(spark, tmp_path, caplog):
    folder = str(tmp_path)
    deliver(spark, f"{folder}/in", rows(1, range(3)) + rows(2, range(10, 12), kind="b"))
    with caplog.at_level(logging.INFO, "jobs.observation_ingest"):
        first = by_day(run(spark, folder))
    assert first == {("2024-01-01", "a"): (3, 0, 3, 2.0, 2.0, 2.9), ("2024-01-02", "b"): (2, 2, 2, None, None, None)}
    assert "read 5 new rows" in caplog.text and "accepted 3" in caplog.text and "value 2" in caplog.text
    untouched = sorted(os.listdir(f"{folder}/out/summary/day=2024-01-02"))

    deliver(spark, f"{folder}/in", rows(1, [2, 3, 3]) + rows(3, [20], value=-20.0, kind="b"))  # one seen before, one twice
    caplog.clear()
    with caplog.at_level(logging.INFO, "jobs.observation_ingest"):
        second = by_day(run(spark, folder))
    assert second == {("2024-01-01", "a"): (4, 0, 4, 2.5, 2.5, 3.85), ("2024-01-02", "b"): first["2024-01-02", "b"], ("2024-01-03", "b"): (1, 0, 1, 0.0, 0.0, 0.0)}
    assert "read 4 new rows" in caplog.text
    assert sorted(os.listdir(f"{folder}/out/summary/day=2024-01-02")) == untouched  # a day without news is not written again

    before = shown(spark.read.parquet(f"{folder}/out/observations"))
    caplog.clear()
    with caplog.at_level(logging.INFO, "jobs.observation_ingest"):
        assert by_day(run(spark, folder)) == second
    assert "read 0 new rows" in caplog.text and shown(spark.read.parquet(f"{folder}/out/observations")) == before


def test_rejects_keep_their_reason(spark, tmp_path):
    folder = str(tmp_path)
    odd = rows(1, [1], value=100.0) + rows(1, [2], value=None) + rows(1, [3], value=float("nan")) + rows(None, [4]) + rows(1, [5], kind="z") + rows(1, [6], kind=None)
    odd += rows(1, [7], value=-6.0, props="no json") + rows(1, [8], value=-6.0, props='{"k": 9}') + rows(1, [9], value=-6.0, props=None) + rows(1, [10], value=-6.0, props='{"k": "x"}') + rows(1, [11], value=-6.0)
    odd += [(None, datetime.datetime(2024, 1, 1), 1, "a", 1.0, '{"k": 1}')] * 2 + [(12, None, None, None, None, None)]
    deliver(spark, f"{folder}/in", odd)
    got = by_day(run(spark, folder))
    reasons = {r.event_id: r.reason for r in spark.read.parquet(f"{folder}/out/observations").collect()}
    assert reasons == {1: "value", 2: "value", 3: "value", 4: "time", 5: "type", 6: "type", 7: "property", 8: "property", 9: "property", 10: "property", 11: None, None: "id", 12: "time"}
    assert got["2024-01-01", "a"] == (10, 9, 8, 5.0, 5.0, 5.0) and got["none", "unknown"][:2] == (1, 1) and got["2024-01-01", "unknown"][:2] == (1, 1)


def test_no_files_and_several_batches(spark, tmp_path):
    folder = str(tmp_path)
    os.makedirs(f"{folder}/in")
    assert run(spark, folder).count() == 0
    for k in range(5):
        deliver(spark, f"{folder}/in", rows(1 + k % 2, [k, k + 1], value=0.0))
    got = by_day(run(spark, folder))
    batches = {r.batch for r in spark.read.parquet(f"{folder}/out/observations").select("batch").collect()}
    assert len(batches) > 1 and got["2024-01-01", "a"][0] == 6 and got["2024-01-02", "a"][0] == 4


def test_a_failed_batch_is_taken_again(spark, tmp_path, monkeypatch):
    broken, whole = str(tmp_path / "broken"), str(tmp_path / "whole")
    for folder in (broken, whole):
        deliver(spark, f"{folder}/in", rows(1, range(5)) + rows(2, range(5, 9)))
        run(spark, folder)
        deliver(spark, f"{folder}/in", rows(1, range(3, 8)) + rows(4, range(5)))
    true_replace, calls = ingest._replace, []

    def fails(frame, path, *partitions):
        calls.append(path)
        if path.endswith("summary"):
            raise RuntimeError("lost")
        true_replace(frame, path, *partitions)

    monkeypatch.setattr(ingest, "_replace", fails)
    with pytest.raises(Exception, match="lost"):
        run(spark, broken)
    assert len(calls) == 2
    monkeypatch.setattr(ingest, "_replace", true_replace)
    assert by_day(run(spark, broken)) == by_day(run(spark, whole))
    both = [shown(spark.read.parquet(f"{f}/out/observations")) for f in (broken, whole)]
    assert both[0] == both[1]


def test_release_keeps_copies_together(spark, tmp_path):
    texts = ["One two  three", "one two\nTHREE ", "other", "", None, " \t", "É alone", "é alone"] + [f"text {i}" for i in range(60)] + ["hot copy"] * 40
    docs = [(i if i != 7 else None, t, None if i % 9 == 0 else "en", "s", None if t is None else len(t), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(0, 1, 0), (0, 0, None), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    got = [shown(text_release.release_texts(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", queries._config("text_release"))) for _ in range(2)]
    assert got[0] == got[1]
    found = spark.read.parquet(f"{tmp_path}/out/records").collect()
    assert len(found) == len(texts) - 3
    of = {r.doc_id: r for r in found}
    assert of[0].text_group == of[1].text_group and of[0].split == of[1].split and of[6].text_group != found[[r.doc_id for r in found].index(None)].text_group
    assert len({r.split for r in found if r.text == "hot copy"}) == 1 and (of[0].quality, of[0].toxic, of[1].quality) == (1, 0, None)
    groups = {r.text_group for r in found}
    tested = {r.text_group for r in found if r.split == "test"}
    assert len(tested) == round(0.1 * len(groups)) and {r.split for r in found} == {"test", *(f"fold{k}" for k in range(5))}
    counts = spark.read.json(f"{tmp_path}/out/counts").agg(F.sum("n_rows"), F.sum("n_groups"), F.sum("n_labelled")).first()
    assert counts[0] == len(found) and counts[2] == 1


def test_release_names_each_text_twice_at_most(spark, tmp_path, monkeypatch):
    """Once for the ranks of groups and once for the records."""
    named, true_groups = spark.sparkContext.accumulator(0), text_release.text_groups

    def counted(texts: pd.Series) -> pd.Series:
        named.add(len(texts))
        return true_groups(texts)

    monkeypatch.setattr(text_release, "text_groups", counted)
    spark.createDataFrame([(i, f"text {i % 30}", "en", "s", 7) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    assert text_release.release_texts(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", queries._config("text_release")).count() == 50
    assert named.value == 100


def test_text_groups_fold_ascii_alone(spark):
    """As translate, a pattern and MD5 of the engine have it."""
    texts = ["A\tB", " a  b\x0b", "a\x1cb", "a\u00a0B", "É\u2003x", "İI", "a\x85b", "", None, "\x0c ", "x" * 5000]
    low = F.translate("t", string.ascii_uppercase, string.ascii_lowercase)
    plain = F.trim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "))
    told = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.when(plain != "", F.substring(F.md5(plain.cast("binary")), 1, 12)).alias("g")).orderBy("i").collect()
    assert text_release.text_groups(pd.Series([t.encode() if t is not None else None for t in texts])).tolist() == [r.g for r in told]


def test_release_of_no_records(spark, tmp_path):
    spark.createDataFrame([(1, " ", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    assert text_release.release_texts(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out", queries._config("text_release")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("job", queries.QUERIES, ids=lambda f: f.__name__)
def test_registered_job_matches_sql(spark, job):
    con = duckdb.connect()
    for t in ("events", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    before = dict(spark.sparkContext.getConf().getAll())
    a, b = job(spark, DATA).toPandas(), con.sql(queries.SQL[job.__name__]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b) > 0
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert ((a == b) | (a.isna() & b.isna())).all().all()
    assert dict(spark.sparkContext.getConf().getAll()) == before


@pytest.mark.parametrize("module", [ingest, text_release])
def test_command_lines(module, monkeypatch, capsys):
    monkeypatch.setattr(sys, "argv", ["job", "--help"])
    with pytest.raises(SystemExit):
        module.main()
    assert "--config" in capsys.readouterr().out
    with open(module.__file__.removesuffix("py") + "json", encoding="utf-8") as f:
        assert json.load(f)
