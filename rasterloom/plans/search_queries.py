"""Queries of searches, samples, draws and text scans over the driver's tables, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import resample
from ..operators import metrics, raster, splits
from ..operators import model as M
from ..sources import sinks, tables
from . import pipelines
from . import tables as T
from .queries import rounded
from .row_queries import _folder

#: Pixels that are drawn from each block of rows, and rows of a block.
SAMPLED, BLOCK = 50, 16
#: Fixed weights of a small network, spelled out in the SQL too.
NET = M.Perceptron([(np.array([[0.5, -1.0], [1.5, 0.25], [-0.75, 2.0]]), np.array([0.1, -0.2])), (np.array([[1.0], [-2.0]]), np.array([0.3]))], "gelu")


def scale_search(spark: SparkSession, d: str) -> DataFrame:
    """The scale of each type on a grid of steps of 0.005, for a gate and a residual that vary by row."""
    v, inside = F.col("value"), F.col("user_id") % 3 == 0
    frame = T.read(spark, d, "events").select("event_type", (v + 20).alias("anchor"), (v * 0.4 - 5).alias("residual"), (F.col("event_id") % 7 / 7).alias("gate"), inside.alias("inside"), (v * F.when(inside, 1.15).otherwise(1.0) + 20).alias("measured"))
    return rounded(metrics.scale_star(frame, "event_type", "measured", "anchor", "residual", "gate", "inside", 2.0, 0.005))


def sampled_medians(spark: SparkSession, d: str) -> DataFrame:
    """Band statistics whose medians come from a bounded sample of each block of rows."""
    pixels = T.pixels(spark, d).withColumn("window", F.floor(F.col("row") / BLOCK)).withColumn("at", F.col("row").cast("long") * 4294967296 + F.col("col"))
    return rounded(pipelines.sampled_statistics(pixels, "window", "at", SAMPLED).select("band", "n", "n_sampled", "mean", "std", "median"))


def weighted_draws(spark: SparkSession, d: str) -> DataFrame:
    """An epoch of draws with replacement: as many as there are events, by their value."""
    events = T.read(spark, d, "events").select("event_id", "value")
    return rounded(splits.weighted_draws(events, "value", "event_id", events.count(), 42).select("draw", "event_id"))


def gelu_rows(spark: SparkSession, d: str) -> DataFrame:
    x = T.read(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("x"))
    return M.apply_model(x, NET, "x", "y").select("vec_id", F.round(F.get("y", 0).cast("double"), 4).alias("y"))


def spectra_scan(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as list literals in a CSV, read again as spectra; one list in five is cut off and rejected; only wanted ids are parsed."""
    path = _folder(spark, "spectra")
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000) / 1000)
    shown = F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ", "), F.lit("]"))
    waves = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda k: (k * 5 + 300).cast("string")), ", "), F.lit("]"))
    source = T.read(spark, d, "embeddings").select("vec_id", "label", waves.alias("waves"), shown.alias("shown"))
    rows = source.select(F.col("vec_id").alias("ref_id"), F.col("label").alias("obs_id"), "waves", F.when(F.col("vec_id") % 5 == 0, F.substring("shown", 1, 20)).otherwise(F.col("shown")).alias("photom_iof"))
    sinks.csv(rows, path)
    ids = T.read(spark, d, "customer").select(F.col("c_custkey").alias("ref_id"))
    usable, rejected = tables.readable_spectra(tables.spectra(spark, path))
    wanted = tables.only_ids(usable, ids)
    found = wanted.groupBy(F.col("obs_id").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.get("waves", -1 + 64)).alias("last_wave"), F.sum(F.get("photom_iof", 2)).alias("third"))
    refused = rejected.groupBy(F.col("obs_id").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n_rejected"))
    return rounded(found.join(refused, "label", "full"))


def linear_resample(spark: SparkSession, d: str) -> DataFrame:
    """Vectors at irregular wavelengths, linearly on the grid of 231 points; NaN beyond their ends."""
    e = F.col("embedding").cast("array<double>")
    waves = F.transform(e, lambda x, k: F.lit(300.0) + k * 18.3 + x)
    found = T.read(spark, d, "embeddings").select("vec_id", resample.resample_linear(waves, e).alias("y"))
    return rounded(found.select("vec_id", F.posexplode("y").alias("band", "y")).where(~F.isnan("y")))


#: Corners in hundredths of a degree: plain, with a spike, two lobes that touch, with a hole that touches the outline.
RINGS = (((0, 0), (4, 0), (4, 4), (0, 4)), ((0, 0), (4, 0), (4, 4), (2, 4), (2, 9), (2, 4), (0, 4)), ((0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4)), ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 2), (2, 2), (2, 1)))


def ring_repair(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of rings that touch themselves: counts of what is kept, and corners after the repair."""
    k = F.col("c_custkey")
    corner = lambda x, y: F.concat((k % 80).cast("string"), F.lit(f".{x:02d} {y / 100}"))
    texts = [F.concat(F.lit("POLYGON (("), *(c for i, (x, y) in enumerate(ring) for c in ((F.lit(", "),) if i else ()) + (corner(x, y),)), F.lit("))")) for ring in RINGS]
    text = F.when(k % 4 == 0, texts[0]).when(k % 4 == 1, texts[1]).when(k % 4 == 2, texts[2]).otherwise(texts[3])
    kept, counts = raster.clean_catalogue(T.read(spark, d, "customer").select(text.alias("wkt")), "wkt")
    return rounded(counts.join(kept.agg(F.sum(F.size("ring")).alias("n_corners")), how="cross"))


QUERIES = [linear_resample, ring_repair, scale_search, sampled_medians, weighted_draws, gelu_rows, spectra_scan]

_GELU = "(0.5 * ({x}) * (1 + sign({x}) * (1 - {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({x}) * ({x}) / 2))))"


def _gelu(x: str) -> str:
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x}) / sqrt(2::DOUBLE)))"
    return _GELU.format(x=x, t=t)


SQL = {
    "ring_repair": "SELECT count(*)::BIGINT AS n_raw, 0::BIGINT AS n_seam, count(*) FILTER (c_custkey % 4 = 2)::BIGINT AS n_degenerate, 0::BIGINT AS n_oversized, count(*) FILTER (c_custkey % 4 <> 2)::BIGINT AS n_kept, sum(CASE c_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 4 + 1 WHEN 3 THEN 8 ELSE 0 END)::BIGINT AS n_corners FROM customer",
    "linear_resample": """WITH n AS (SELECT vec_id, 300.0::DOUBLE + k * 18.3::DOUBLE + embedding[k + 1]::DOUBLE AS w, embedding[k + 1]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS k FROM embeddings)),
p AS (SELECT vec_id, w AS w0, v AS v0, lead(w) OVER o AS w1, lead(v) OVER o AS v1 FROM n WINDOW o AS (PARTITION BY vec_id ORDER BY w)),
g AS (SELECT range AS band, 300 + 5 * range AS x FROM range(231))
SELECT vec_id, band, round((v1 - v0) / (w1 - w0) * (x - w0) + v0, 6) + 0.0 AS y FROM p JOIN g ON x >= w0 AND x < w1""",
    "scale_search": """WITH e AS (SELECT event_type, user_id % 3 = 0 AS i, value + 20 AS a, value * 0.4::DOUBLE - 5 AS r, (event_id % 7) / 7::DOUBLE AS g, value * CASE WHEN user_id % 3 = 0 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END + 20 AS m FROM events),
tgt AS (SELECT event_type, median(m) FILTER (i) / median(m) FILTER (NOT i) AS t FROM e GROUP BY event_type HAVING count(*) FILTER (i) >= 5 AND count(*) FILTER (NOT i) >= 5),
curve AS (SELECT event_type, k * 0.005::DOUBLE AS s, median(a + (k * 0.005::DOUBLE) * g * r) FILTER (i) / median(a + (k * 0.005::DOUBLE) * g * r) FILTER (NOT i) AS c FROM e, (SELECT unnest(range(401)) AS k) GROUP BY event_type, k)
SELECT event_type, round(s, 6) AS s_star, round(c, 6) AS contrast, round(t, 6) AS target FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(c - t), s) AS n FROM curve JOIN tgt USING (event_type)) WHERE n = 1""",
    "sampled_medians": f"""WITH p AS (SELECT (event_id // 100) // {BLOCK} AS w, (event_id // 100) * 4294967296 + event_id % 100 AS pos, value FROM events),
s AS (SELECT value FROM (SELECT value, row_number() OVER (PARTITION BY w ORDER BY md5('42:' || pos), pos) AS n FROM p) WHERE n <= {SAMPLED}),
b AS (SELECT unnest([0, 1, 2]) AS band), v AS (SELECT band, CASE band WHEN 0 THEN value WHEN 1 THEN value * 2 ELSE 0.5::DOUBLE END AS y FROM p, b), m AS (SELECT band, CASE band WHEN 0 THEN value WHEN 1 THEN value * 2 ELSE 0.5::DOUBLE END AS y FROM s, b)
SELECT a.*, c.n_sampled, c.median FROM (SELECT band::BIGINT AS band, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std FROM v GROUP BY band) a JOIN (SELECT band, count(*) AS n_sampled, round(median(y), 6) AS median FROM m GROUP BY band) c USING (band)""",
    "weighted_draws": """WITH c AS (SELECT event_id, sum(value) OVER (ORDER BY md5('42:' || event_id), event_id ROWS UNBOUNDED PRECEDING) AS upto FROM events WHERE value > 0),
d AS (SELECT range AS draw, ('0x' || substr(md5('42:' || range), 1, 13))::BIGINT / 4503599627370496::DOUBLE * (SELECT max(upto) FROM c) AS pos FROM range((SELECT count(*) FROM events)))
SELECT d.draw, c.event_id FROM d ASOF JOIN c ON d.pos <= c.upto""",
    "gelu_rows": f"""WITH h AS (SELECT vec_id, 0.5 * a + 1.5 * b - 0.75 * c + 0.1::DOUBLE AS u, -1.0 * a + 0.25 * b + 2.0 * c - 0.2::DOUBLE AS v FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings))
SELECT vec_id, round({_gelu("u")} - 2 * {_gelu("v")} + 0.3::DOUBLE, 4) AS y FROM h""",
    "spectra_scan": """WITH e AS (SELECT vec_id, label::BIGINT AS label, floor(embedding[3]::DOUBLE * 1000) / 1000 AS third, 300 + 5 * (len(embedding) - 1) AS last_wave FROM embeddings),
f AS (SELECT label, count(*) AS n, round(sum(CASE WHEN last_wave >= 615 THEN 615 END)::DOUBLE, 6) AS last_wave, round(sum(third), 6) AS third FROM e WHERE vec_id % 5 <> 0 AND vec_id IN (SELECT c_custkey FROM customer) GROUP BY label),
r AS (SELECT label, count(*) AS n_rejected FROM e WHERE vec_id % 5 = 0 GROUP BY label) SELECT * FROM f FULL JOIN r USING (label)""",
}
