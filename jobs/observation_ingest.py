"""Incremental ingest of an observation log: new files only, rejects kept with their reason, summaries of touched days renewed.

Each run is a stream over the files that arrived since the last one (``availableNow``); what has been taken is in the checkpoint. A batch

1. parses the text property of each row and names the first rule that the row breaks (missing rows of a rule are rejects, as in the
   quality filters of the library);
2. leaves out observations that an earlier batch has already brought (same day and id), and repeats within the batch;
3. writes its rows to ``observations/day=/batch=`` and renews ``summary/day=`` of the days that it touched, both by dynamic partition
   overwrite. A batch that is run again after a failure replaces its own partitions and nothing else.

A summary row holds, per day and type: rows, rejects, groups, and mean, median and 95th percentile of the accepted values.

    python -m jobs.observation_ingest --source IN --output OUT --checkpoint MARK [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.order_stats import quantiles
from rasterloom.operators.quality import nan_to_null

log = logging.getLogger("jobs.observation_ingest")

OBSERVATIONS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, property double, reason string, day string, batch long"
SUMMARY = "event_type string, n long, n_rejected long, n_groups long, value_mean double, value_median double, value_p95 double, day string"
#: The day of rows without a time, and the type of rows without one.
NO_DAY, NO_TYPE = "none", "unknown"


def reason(config: dict) -> Column:
    """The first rule that a parsed row breaks; NULL if it is accepted. A missing value breaks its rule."""
    inside = lambda c, bounds: F.coalesce(F.col(c).between(*bounds), F.lit(False))
    rules = [("time", F.col("ts").isNotNull()), ("type", F.col("event_type").isin(config["types"])), ("value", inside("value", config["value_range"])), ("property", inside("property", config["property_range"]))]
    broken = F.when(F.col("event_id").isNull(), F.lit("id"))
    for name, holds in rules:
        broken = broken.when(~holds, F.lit(name))
    return broken


def parsed(rows: DataFrame, config: dict) -> DataFrame:
    """The columns of ``OBSERVATIONS`` but ``batch``."""
    number = F.get_json_object("props", f"$.{config['property']}").try_cast("double")
    named = nan_to_null(rows, "value").select("event_id", "ts", "user_id", F.coalesce("event_type", F.lit(NO_TYPE)).alias("event_type"), "value", number.alias("property"))
    return named.withColumn("reason", reason(config)).withColumn("day", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit(NO_DAY)))


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet; its partitions are those there when this is called."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _replace(frame: DataFrame, path: str, *partitions: str) -> None:
    frame.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def summarise(observations: DataFrame) -> DataFrame:
    """One row per day and type of observations that are unique by day and id."""
    rows = observations.withColumn("accepted", F.when(F.col("reason").isNull(), F.col("value")))
    counts = rows.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("n_rejected"), F.count_distinct("user_id").alias("n_groups"), F.round(F.avg("accepted"), 6).alias("value_mean"))
    middle = quantiles(rows, ["day", "event_type"], {"accepted": {"value_median": 0.5, "value_p95": 0.95}})
    places = {c: F.round(c, 6) for c in ("value_median", "value_p95")}
    return counts.join(middle.withColumns(places), ["day", "event_type"]).select(*(c.split()[0] for c in SUMMARY.split(", ")))


def take_batch(spark: SparkSession, rows: DataFrame, number: int, output: str, config: dict) -> None:
    """Brings one batch in; the same batch may be taken again."""
    here, there = f"{output}/observations", f"{output}/summary"
    earlier = _written(spark, here, OBSERVATIONS).where(F.col("batch") < number).select("day", "event_id").where(F.col("event_id").isNotNull())
    found = parsed(rows, config)
    # One row per day and id, the same whatever the order of the rows. Rows without an id are rejects and stay, each as often as it came.
    others = [c for c in found.columns if c not in ("day", "event_id")]
    whole, nameless = F.struct(*others), F.col("event_id").isNull()
    one = found.groupBy("day", "event_id", F.when(nameless, whole).alias("alike")).agg(F.min(whole).alias("r"), F.count(F.lit(1)).alias("times"))
    one = one.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(nameless, F.col("times")).otherwise(1).cast("int")))).select("day", "event_id", *(F.col(f"r.{c}").alias(c) for c in others))
    fresh = one.join(earlier, ["day", "event_id"], "left_anti").withColumn("batch", F.lit(number).cast("long"))
    _replace(fresh.select(*(c.split()[0] for c in OBSERVATIONS.split(", "))), here, "day", "batch")

    held = _written(spark, here, OBSERVATIONS)
    mine = held.where(F.col("batch") == number)
    # Only partition values are needed for the days; the join then prunes the partitions that are read.
    touched = mine.select("day").distinct()
    _replace(summarise(held.join(touched, "day", "left_semi")), there, "day")
    taken = {r["reason"] or "accepted": r["n"] for r in mine.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    log.info("batch %d: wrote %d rows (%s) of %d days to %s, renewed their summaries", number, sum(taken.values()), ", ".join(f"{k} {n}" for k, n in sorted(taken.items())), touched.count(), here)


def ingest_observations(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes the new files of ``source`` (a folder, or a glob of files) and returns the whole summary as it then stands."""
    stream = spark.readStream.schema(config["schema"]).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    query = stream.writeStream.foreachBatch(lambda rows, number: take_batch(rows.sparkSession, rows, number, output, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows of %s", sum(p.numInputRows for p in query.recentProgress), source)
    return _written(spark, f"{output}/summary", SUMMARY)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("source", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=os.path.splitext(os.path.abspath(__file__))[0] + ".json")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("observation-ingest").getOrCreate()
    try:
        ingest_observations(spark, args.source, args.output, args.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
