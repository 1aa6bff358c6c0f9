"""SQL of ``row_queries`` for DuckDB."""

from __future__ import annotations

from .oracles import PAIRS, PIXELS, PLACES, QUALITY, REST, SPLIT, WIDE, WIDE_PAIRS, _angle, _r

D = "::DOUBLE"
BOXES = f"boxes AS (SELECT n_nationkey, (n_nationkey * 37 % 80){D} + 0.3{D} AS x0, (n_nationkey * 53 % 80){D} + 0.2{D} AS y0 FROM nation)"
GRID = "g AS (SELECT a.range AS r, b.range AS c FROM range(100) a, range(100) b)"
CELL = f"floor((radians(lat) * 2439400.0{D} - 80 * pi() / 180 * 2439400) / (-1.6{D} * pi() / 180 * 2439400)) AS r, floor((radians(lon) * 2439400.0{D} + 180 * pi() / 180 * 2439400) / (3.6{D} * pi() / 180 * 2439400)) AS c"
BAND = f"band AS (SELECT i AS band, y[i + 1] AS y FROM (SELECT y, unnest(range(231)) AS i FROM wide))"


def _split_row(name: str, rule: str) -> str:
    return f"SELECT '{name}' AS part, count(*)::BIGINT AS n, {_r('sum(value)', 'total')} FROM e WHERE {rule}"


def _ops(name: str, rule: str) -> str:
    return f"""SELECT '{name}' AS op, count(*)::BIGINT AS n, sum("row")::BIGINT AS rows FROM m WHERE {rule}"""


ROW_SQL = {
    "nodata_masking": "SELECT event_type, sum((user_id % 7 = 0)::INT + (user_id % 5 = 0)::INT)::BIGINT AS n_masked, count(*) FILTER (user_id % 7 <> 0 AND user_id % 5 <> 0)::BIGINT AS n_complete FROM events GROUP BY event_type",
    "split_selection": f"WITH {SPLIT}, e AS (SELECT value, split FROM events JOIN split USING (user_id)) " + " UNION ALL ".join([_split_row("train", "split NOT IN ('test', 'fold0')"), _split_row("validation", "split = 'fold0'"), _split_row("test", "split = 'test'")]),
    "rejected_spectra": f"SELECT c_nationkey::BIGINT AS c_nationkey, nullif(count(*) FILTER (c_custkey % 4 = 2), 0)::BIGINT AS n_usable, {_r('sum(c_custkey) FILTER (c_custkey % 4 = 2)::DOUBLE', 'total')}, nullif(count(*) FILTER (c_custkey % 4 <> 2), 0)::BIGINT AS n_rejected FROM customer GROUP BY c_nationkey",
    "model_inputs": f"SELECT vec_id, 9::BIGINT AS n, {_r('embedding[8]::DOUBLE', 'last_band')}, {_r(f'((vec_id % 11){D} - 3.5{D}) / 1.25{D}', 'count_z')} FROM embeddings",
    "ratio_variants": f"WITH e AS (SELECT label, embedding[1]{D} AS a, embedding[2]{D} AS b FROM embeddings) SELECT label::BIGINT AS label, count(*) FILTER (b <= 0)::BIGINT AS n_undefined, {_r('sum(a / b) FILTER (b > 0)', 'guarded')}, {_r(f'max(abs(a / greatest(b, 0.05{D})))', 'clipped')} FROM e GROUP BY label",
    "band_choices": f"WITH e AS (SELECT vec_id, embedding{D}[] AS s, list_transform(embedding{D}[], lambda x: abs(x - 0.1{D})) AS gap FROM embeddings) SELECT vec_id, {_r('s[6]', 'b5')}, {_r('s[1]', 'b0')}, {_r('s[64]', 'b63')}, {_r('list_sum(s[10:17])', 'slice_sum')}, (list_position(gap, list_min(gap)) - 1)::BIGINT AS nearest FROM e",
    "per_split_errors": f"WITH {WIDE_PAIRS}, a AS (SELECT CASE label WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, {_angle('p', 't')} AS sam, list_avg(list_transform(list_zip(p, t), lambda z: (z[1] - z[2]) ** 2)) AS mse FROM pairs) SELECT split, count(*)::BIGINT AS n, {_r('avg(mse)', 'mse')}, {_r('median(sam)', 'sam_median')}, {_r('avg(sam)', 'sam_mean')} FROM a GROUP BY split",
    "mask_algebra": f'WITH {PIXELS}, m AS (SELECT "row", value > 60 AS a, col % 3 = 0 AS b FROM pixels) ' + " UNION ALL ".join([_ops("intersection", "a AND b"), _ops("union", "a OR b"), _ops("difference", "a AND NOT b")]),
    "sizes_and_documents": "WITH s AS (SELECT n_nationkey, n_name, pow(7.0::DOUBLE, n_nationkey % 13)::BIGINT AS n FROM nation) SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n < 1024 THEN printf('%.2f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2f KiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.2f MiB', n / 1048576.0::DOUBLE) ELSE printf('%.2f GiB', n / 1073741824.0::DOUBLE) END AS size, n, n_name AS name FROM s",
    "standardiser": f"SELECT {_r('avg(value)', 'mean', 3)}, {_r('stddev_pop(value) + 1e-8', 'std', 3)} FROM events",
    "sampling_mass": f"WITH c AS (SELECT count(*) FILTER (l_returnflag = 'R'){D} AS s, count(*) FILTER (l_returnflag <> 'R'){D} AS r FROM lineitem) SELECT {_r(f'0.3{D} * r / (0.7{D} * s)', 'weight')}, {_r(f'0.3{D}', 'share')} FROM c",
    "hold_out": "WITH g AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id::VARCHAR), user_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)), h AS (SELECT user_id, k <= greatest(1, round_even(0.15::DOUBLE * n, 0)) AS v FROM g) SELECT v AS is_validation, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_groups FROM events JOIN h USING (user_id) GROUP BY v",
    "array_comparison": f"WITH {PAIRS} SELECT 'near' AS pair, count(*)::BIGINT AS n, TRUE AS all_close, 0.0{D} AS gap FROM pairs UNION ALL SELECT 'far', count(*), FALSE, {_r('max(list_max(list_transform(list_zip(t, p), lambda z: abs(z[1] - z[2]))))')} FROM pairs",
    "model_comparison": f"WITH {PAIRS}, c AS (SELECT unnest(t) AS a, unnest(p) AS b FROM pairs) SELECT {_r('corr(a, b)', 'correlation')}, {_r('median(abs(a))', 'median_abs_a')}, {_r('median(abs(b))', 'median_abs_b')}, {_r('max(abs(a - b))', 'max_abs_diff')}, {_r('sqrt(avg((a - b) ** 2))', 'rms_diff')} FROM c",
    "mosaic_bands": f"WITH {WIDE}, {BAND} SELECT band::BIGINT AS band, {_r(f'300.0{D} + 5 * band', 'wavelength_nm')}, {_r('avg(y)', 'mean')}, {_r('stddev_pop(y)', 'std')}, {_r('median(y)', 'median')} FROM band GROUP BY band",
    "red_slope": f"WITH {WIDE}, {BAND} SELECT {_r('100 * ((SELECT median(y) FROM band WHERE band = 230) / (SELECT median(y) FROM band WHERE band = 90) - 1)', 'red_slope_pct')}",
    "gram_cells": f"WITH {PAIRS}, r AS (SELECT list_transform(list_zip(t, p), lambda z: z[1] - z[2]) AS r FROM pairs), ij AS (SELECT a.range AS i, b.range AS j FROM range(64) a, range(64) b WHERE b.range >= a.range) SELECT i::BIGINT AS i, j::BIGINT AS j, {_r('sum(r[i + 1] * r[j + 1])', 'value')} FROM r, ij GROUP BY i, j",
    "table_to_grid": f"WITH p AS (SELECT n_nationkey * 97.0{D} + 310 AS x, n_nationkey * n_regionkey + 1.0{D} AS y FROM nation WHERE n_nationkey < 12), g AS (SELECT range AS band, 300.0{D} + 5 * range AS w FROM range(231)), s AS (SELECT band, w, arg_max(y, x) FILTER (x <= w) AS y0, max(x) FILTER (x <= w) AS x0, arg_min(y, x) FILTER (x > w) AS y1, min(x) FILTER (x > w) AS x1 FROM g, p GROUP BY band, w) SELECT band::BIGINT AS band, {_r('w', 'wavelength_nm')}, {_r('CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (w - x0) / (x1 - x0) END', 'mean')} FROM s",
    "spread_of_pixels": f"WITH {PIXELS}, s AS (SELECT value AS v, (value * 0.6{D} + col) / value AS q FROM pixels WHERE value > 5) SELECT count(*)::BIGINT AS n_background_pixels, {_r('avg(v)', 'mu_level')}, {_r('stddev_pop(v)', 'sd_level')}, {_r('avg(q)', 'mu_ratio')}, {_r('stddev_pop(q)', 'sd_ratio')}, {_r('round(stddev_pop(v) / 25, 3)', 'sigma_level_over_footprints')}, {_r('round(stddev_pop(q) / 0.5, 3)', 'sigma_ratio_over_footprints')}, {_r('round(100 * avg(((v - 50) / (25 + 1e-9) > 0.5 AND (q - 1.2) / (0.5 + 1e-9) > 0.5)::INT), 3)', 'background_passing_pct')} FROM s",
    "disk_gate": f'WITH {PIXELS}, n AS (SELECT s_suppkey, "row", col, value + 1 AS bright, value * (col * 0.01{D} + 0.6{D}) / (value + 1) AS blue FROM pixels JOIN supplier ON sqrt(("row" - s_suppkey * 31 % 100) ** 2 + (col - s_suppkey * 17 % 100) ** 2) <= s_suppkey % 5 + 2.5), l AS (SELECT s_suppkey, quantile_cont(bright, 0.82{D}) AS b, quantile_cont(blue, 0.65{D}) AS q FROM n GROUP BY s_suppkey HAVING count(*) >= 5) SELECT s_suppkey, count(*)::BIGINT AS n, sum("row")::BIGINT AS rows, sum(col)::BIGINT AS cols FROM n JOIN l USING (s_suppkey) WHERE bright >= b AND blue >= q GROUP BY s_suppkey',
    "disk_radii_and_centres": f"SELECT s_suppkey, {_r(f'greatest(sqrt((s_suppkey % 50){D} / pi()) * 1.5, 3.0)', 'radius_km')}, {_r(f'(s_suppkey % 77 + 0.5{D}) * 3.6{D} - 180', 'lon')}, {_r(f'80 - (s_suppkey % 100 + 0.5{D}) * 1.6{D}', 'lat')} FROM supplier",
    "point_sample": f'WITH {PLACES}, {PIXELS}, c AS (SELECT c_custkey, {CELL} FROM places) SELECT c_custkey, r::BIGINT AS "row", c::BIGINT AS col, {_r("value", "value")}, coalesce(value > 60, FALSE) AS bright FROM c LEFT JOIN pixels p ON p."row" = r AND p.col = c.c',
    "window_around": f'WITH {PIXELS} SELECT count(*)::BIGINT AS n, {_r("sum(value)", "total")}, min("row")::BIGINT AS top, max(col)::BIGINT AS "right" FROM pixels WHERE "row" BETWEEN floor((80 - 35) / 1.6{D}) AND floor((80 + 15) / 1.6{D}) AND col BETWEEN floor((180 + 15) / 3.6{D}) AND floor((180 + 65) / 3.6{D})',
    "zonal_mean_boxes": f'WITH {PIXELS}, {BOXES} SELECT n_nationkey::BIGINT AS n_nationkey, {_r("avg(s[1])", "b0")}, {_r("avg(s[2])", "b1")}, {_r("avg(s[3])", "b2")} FROM boxes JOIN pixels ON "row" < 100 AND col <= x0 + 6.4 AND col + 1 >= x0 AND "row" <= y0 + 3.1 AND "row" + 1 >= y0 GROUP BY n_nationkey',
    "dilated_boxes": f'WITH {BOXES}, {GRID} SELECT DISTINCT r::BIGINT AS "row", c::BIGINT AS col FROM g JOIN boxes ON greatest(x0 - c - 0.5, 0, c + 0.5 - x0 - 6.4) ** 2 + greatest(y0 - r - 0.5, 0, r + 0.5 - y0 - 3.1) ** 2 <= 1.25{D} ** 2',
    "seam_split": f"WITH b AS (SELECT n_nationkey, n_nationkey * 15.0{D} - 190 AS x FROM nation) SELECT n_nationkey::BIGINT AS n_nationkey, (1 + (x < -180 OR x + 20 > 180)::INT)::BIGINT AS n_pieces, {_r(f'100.0{D}', 'area')} FROM b",
    "polygon_cleaning": "SELECT count(*) FILTER (c_custkey % 5 <> 3)::BIGINT AS n_raw, count(*) FILTER (c_custkey % 5 = 2)::BIGINT AS n_seam, count(*) FILTER (c_custkey % 5 = 1)::BIGINT AS n_degenerate, count(*) FILTER (c_custkey % 5 = 0)::BIGINT AS n_oversized, count(*) FILTER (c_custkey % 5 = 4)::BIGINT AS n_kept FROM customer",
    "footprint_rejection": f"WITH k AS (SELECT n_nationkey AS n, n_nationkey % 3 AS m, CASE n_nationkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE 14 * n_nationkey + 2 <= 180 END AS kept FROM nation) SELECT n::BIGINT AS n_nationkey, kept, CASE WHEN kept THEN CASE m WHEN 0 THEN 1 ELSE 2 END END::BIGINT AS n_rings, CASE WHEN kept THEN {_r(f'CASE m WHEN 0 THEN n + 4 ELSE 2 - 7 * n END{D}')} END AS second_lon FROM k",
    "perceptron_rows": f"WITH x AS (SELECT vec_id, embedding[1]{D} AS a, embedding[2]{D} AS b, embedding[3]{D} AS c FROM embeddings) SELECT vec_id, CASE WHEN vec_id % 4 > 0 THEN round(greatest(0.5 * a + 1.5 * b - 0.75 * c + 0.1, 0) - 2 * greatest(-a + 0.25 * b + 2 * c - 0.2, 0) + 0.3, 3) + 0.0 END AS y FROM x",
    "correction_layer": f'WITH {PIXELS}, f AS (SELECT "row", value AS v, value * 0.6{D} + col AS t, (4.0{D} - 3) / 2 AS z FROM pixels WHERE col < 60 AND col % 6 <> 0 AND value > 0), k AS (SELECT "row", 0.1{D} * t + 3.5{D} * v + 0.9{D} * z + 0.01{D} AS c0, -1.4{D} * v - 0.4{D} * z + 0.02{D} AS c1 FROM f WHERE (v - 50) / (25 + 1e-9) > 0.5 AND (t / v - 1.2{D}) / (0.5{D} + 1e-9) > 0.5) SELECT "row"::BIGINT AS "row", count(*)::BIGINT AS n, {_r("sum(c0)", "c0", 1)}, {_r("sum(c1)", "c1", 1)}, 0.4{D} AS g FROM k GROUP BY "row"',
    "tiles_round_trip": f'WITH {PIXELS} SELECT "row"::BIGINT AS "row", count(*)::BIGINT AS n, {_r("sum(value)", "total")}, {_r("max(s[2])", "top")} FROM pixels WHERE "row" >= 20 AND "row" < 70 GROUP BY "row"',
    "csv_round_trip": f"WITH {QUALITY} SELECT l_returnflag AS obs_id, count(*)::BIGINT AS n, {_r('sum(q3)', 'q3')} FROM quality WHERE q1 BETWEEN 0.9{D} AND 1.1{D} AND {REST} GROUP BY l_returnflag",
    "parquet_resume": f"SELECT {_r('sum(o_totalprice) FILTER (o_orderkey % 4 < 3)', 'total', 2)}, count(*) FILTER (o_orderkey % 4 < 3)::BIGINT AS n_done, count(DISTINCT o_orderkey) FILTER (o_orderkey % 4 = 3)::BIGINT AS n_left FROM orders",
    "stage_counts": "SELECT 'some rows' AS name, count(*) > 0 AS ok FROM documents UNION ALL SELECT 'document ids', count(*) = count(DISTINCT doc_id) FROM documents",
}
