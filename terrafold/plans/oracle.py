"""Independent SQL for each catalog query, run on the same Parquet tables by DuckDB."""

from __future__ import annotations

import re

_VIEWS = {
    "points": """
  SELECT o_orderkey AS row_id,
         concat(CASE WHEN o_orderkey % 2 = 0 THEN 'wheat_' ELSE 'maize_' END, CAST(o_orderkey AS VARCHAR)) AS cell_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'wheat' ELSE 'maize' END AS crop,
         CAST(74.875 AS DOUBLE) - CAST((o_custkey * 7 + o_orderkey * 13) % 540 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS lat,
         CAST(-179.875 AS DOUBLE) + CAST((o_orderkey * 31) % 1440 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS lon,
         CAST(least(10000, floor(coalesce(CAST(ext AS DOUBLE), 0) / 50)) AS INTEGER) AS suitability,
         n_lines, CAST(qty AS DOUBLE) AS qty, CAST(ext AS DOUBLE) AS ext,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE dmax END AS sg_clay_0_30,
         tmax AS sg_sand_0_30,
         CASE WHEN o_orderkey % 101 = 0 THEN 'HTTP 503' END AS power_error
  FROM orders LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_lines, sum(CAST(l_quantity AS DECIMAL(12,2))) AS qty,
           sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS ext, max(l_discount) AS dmax, max(l_tax) AS tmax
    FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "climate_responses": """
  SELECT cell_id, k AS attempt,
         CASE WHEN row_id % 101 = 0 OR (k = 1 AND row_id % 7 = 0) THEN 503 ELSE 200 END AS status,
         CASE WHEN row_id % 101 = 0 OR (k = 1 AND row_id % 7 = 0) THEN NULL ELSE
           concat('{"geometry":{"coordinates":[', CAST(row_id % 360 - 180 AS VARCHAR), ',', CAST(row_id % 120 - 60 AS VARCHAR),
                  ']},"properties":{"elevation":', CAST(row_id % 900 AS VARCHAR),
                  ',"parameter":{"T2M":{"JAN":', CAST(row_id % 40 - 10 AS VARCHAR), ',"OCT":', CAST(row_id % 30 AS VARCHAR),
                  ',"ANN":', CAST(row_id % 25 AS VARCHAR), '},"PRECTOTCORR":{"JAN":', CAST(row_id % 9 AS VARCHAR),
                  ',"OCT":', CAST(row_id % 8 AS VARCHAR), ',"ANN":', CAST(row_id % 7 AS VARCHAR), '}}}}') END AS body
  FROM points CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) t
  WHERE k = 1 OR row_id % 7 = 0 OR row_id % 101 = 0""",
    "grid_cells": """
  SELECT CASE l_linenumber % 3 WHEN 0 THEN '0-5cm' WHEN 1 THEN '5-15cm' ELSE '15-30cm' END AS grid_id,
         CAST((l_partkey * 7 + l_linenumber) % 68 AS INTEGER) AS r, CAST((l_suppkey * 11 + l_orderkey) % 180 AS INTEGER) AS c,
         CAST(floor(CAST(sum(CAST(l_quantity AS INTEGER)) AS DOUBLE) * 10 / count(*)) AS INTEGER) AS value
  FROM lineitem GROUP BY 1, 2, 3""",
    "predictions": """
  SELECT model, CAST(row_id % 5 + 1 AS INTEGER) AS fold, row_id AS row_index, crop, lat, lon, observed, predicted,
         observed - predicted AS residual, abs(observed - predicted) AS abs_error,
         (observed - predicted) * (observed - predicted) AS squared_error
  FROM (SELECT 'A' AS model, row_id, crop, lat, lon, CAST(suitability AS DOUBLE) AS observed,
               CAST(1000 + coalesce(qty, 0) * 30 AS DOUBLE) AS predicted FROM points
        UNION ALL
        SELECT 'B', row_id, crop, lat, lon, CAST(suitability AS DOUBLE),
               CAST(500 + floor(coalesce(ext, 0) / 60) AS DOUBLE) FROM points) u""",
    "contributions": """
  SELECT row_id, crop, 'is_wheat' AS feature, CAST(crop = 'wheat' AS DOUBLE) AS value,
         CAST(CASE WHEN crop = 'wheat' THEN 100 ELSE 0 END - 40 + row_id % 7 AS DOUBLE) AS contribution FROM points
  UNION ALL SELECT row_id, crop, 'T2M_OCT', CAST(row_id % 30 AS DOUBLE), CAST((row_id % 30) * 3 - 40 AS DOUBLE) FROM points
  UNION ALL SELECT row_id, crop, 'WS2M_ANN', CAST(row_id % 11 AS DOUBLE), CAST((row_id % 11) * 2 - 9 AS DOUBLE) FROM points
  UNION ALL SELECT row_id, crop, 'sg_clay_0_30', coalesce(sg_clay_0_30, 0), coalesce(sg_clay_0_30, 0) * 1000 - 50 FROM points
  UNION ALL SELECT row_id, crop, 'power_elevation_m', CAST(row_id % 900 AS DOUBLE), CAST(row_id % 900 AS DOUBLE) / 10 - 45 FROM points""",
    "fold_scores": """
  SELECT model, crop, fold, count(*) AS n, 1 - sum(squared_error) / (var_pop(observed) * count(*)) AS r2,
         sqrt(avg(squared_error)) AS rmse, avg(abs_error) AS mae
  FROM predictions GROUP BY model, crop, fold""",
    "deltas": """
  SELECT a.crop, a.fold, m.metric,
         CASE m.metric WHEN 'RMSE_A_minus_B' THEN a.rmse - b.rmse WHEN 'MAE_A_minus_B' THEN a.mae - b.mae
                       ELSE b.r2 - a.r2 END AS difference
  FROM fold_scores a JOIN fold_scores b ON a.crop = b.crop AND a.fold = b.fold AND a.model = 'A' AND b.model = 'B',
       (VALUES ('RMSE_A_minus_B'), ('MAE_A_minus_B'), ('R2_B_minus_A')) m(metric)""",
    "runs": """
  SELECT concat(model, '_block', CASE deg WHEN 5 THEN '5p0' ELSE '10p0' END) AS run_name, model AS model_name,
         CAST(deg AS DOUBLE) AS spatial_block_deg, avg(r2) AS spatial_r2_mean, stddev_samp(r2) AS spatial_r2_std,
         avg(rmse) AS spatial_rmse_mean, stddev_samp(rmse) AS spatial_rmse_std,
         avg(mae) AS spatial_mae_mean, stddev_samp(mae) AS spatial_mae_std, count(*) AS spatial_n_splits
  FROM (SELECT model, deg, fold, 1 - sum(squared_error) / (var_pop(observed) * count(*)) AS r2,
               sqrt(avg(squared_error)) AS rmse, avg(abs_error) AS mae
        FROM (SELECT *  EXCLUDE (fold), (floor((lat + 90) / deg) + floor((lon + 180) / deg)) % 5 AS fold
              FROM predictions, (VALUES (5), (10)) d(deg)) x
        GROUP BY model, deg, fold) y
  GROUP BY model, deg""",
    "blocks": """
  SELECT concat(CAST(CAST(floor((lat + 90) / 10) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor((lon + 180) / 10) AS BIGINT) AS VARCHAR)) AS block_id,
         count(*) AS n_rows
  FROM points GROUP BY 1""",
    "block_order": """
  SELECT block_id, n_rows, row_number() OVER (ORDER BY n_rows DESC, md5(block_id), block_id) AS i FROM blocks""",
    # Plain greedy, one block at a time: largest first, to the lightest fold.
    "greedy": """
  SELECT CAST(0 AS BIGINT) AS i, '' AS block_id, CAST(0 AS INTEGER) AS fold, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads
  UNION ALL
  SELECT o.i, o.block_id, CAST(list_position(g.loads, list_min(g.loads)) AS INTEGER),
         list_transform(g.loads, lambda x, k: CASE WHEN k = list_position(g.loads, list_min(g.loads)) THEN x + o.n_rows ELSE x END)
  FROM greedy g JOIN block_order o ON o.i = g.i + 1""",
    "folded": """
  SELECT p.*, g.block_id, g.fold FROM points p JOIN greedy g ON g.i > 0 AND g.block_id =
    concat(CAST(CAST(floor((lat + 90) / 10) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor((lon + 180) / 10) AS BIGINT) AS VARCHAR))""",
    "baseline": """
  SELECT f.fold, CAST(f.suitability AS DOUBLE) AS observed, m.predicted
  FROM folded f JOIN (
    SELECT fold, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS predicted
    FROM (SELECT fold, CAST(sum(suitability) AS DOUBLE) AS s, count(*) AS n FROM folded GROUP BY fold) t) m ON m.fold = f.fold""",
    "baseline_scores": """
  SELECT 'mean' AS model, fold, count(*) AS n_test,
         1 - sum((observed - predicted) * (observed - predicted)) / (var_pop(observed) * count(*)) AS r2,
         sqrt(avg((observed - predicted) * (observed - predicted))) AS rmse, avg(abs(observed - predicted)) AS mae
  FROM baseline GROUP BY fold""",
    "climate": """
  SELECT p.cell_id,
         CAST(json_extract_string(body, '$.geometry.coordinates[0]') AS DOUBLE) AS power_lon,
         CAST(json_extract_string(body, '$.geometry.coordinates[1]') AS DOUBLE) AS power_lat,
         CAST(json_extract_string(body, '$.properties.elevation') AS DOUBLE) AS power_elevation_m,
         {params}
         CASE WHEN body IS NULL THEN 'HTTP 503' END AS power_error
  FROM (SELECT DISTINCT cell_id FROM climate_responses) p
  LEFT JOIN (SELECT cell_id, body FROM climate_responses WHERE status = 200
             QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY attempt) = 1) r ON r.cell_id = p.cell_id""",
    "sampled": """
  SELECT p.row_id, p.lat, p.lon, g1.value AS v1, g2.value AS v2, g3.value AS v3
  FROM points p
  LEFT JOIN grid_cells g1 ON g1.grid_id = '0-5cm' AND g1.value <> 300 AND g1.r = floor((lat - 75) / -2) AND g1.c = floor((lon + 180) / 2)
  LEFT JOIN grid_cells g2 ON g2.grid_id = '5-15cm' AND g2.value <> 300 AND g2.r = floor((lat - 75) / -2) AND g2.c = floor((lon + 180) / 2)
  LEFT JOIN grid_cells g3 ON g3.grid_id = '15-30cm' AND g3.value <> 300 AND g3.r = floor((lat - 75) / -2) AND g3.c = floor((lon + 180) / 2)""",
    "importances": """
  SELECT feature, m AS mean_abs_contrib, 100 * m / sum(m) OVER () AS importance_pct
  FROM (SELECT feature, avg(abs(contribution)) AS m FROM contributions GROUP BY feature) t""",
    "prepared": """
  SELECT row_id, lat, lon, crop, CAST(greatest(0, least(10000, suitability)) AS INTEGER) AS suitability, qty, ext,
         coalesce(sg_clay_0_30, median(sg_clay_0_30) OVER ()) AS sg_clay_0_30,
         coalesce(sg_sand_0_30, median(sg_sand_0_30) OVER ()) AS sg_sand_0_30,
         CAST(crop = 'wheat' AS INTEGER) AS is_wheat
  FROM points WHERE power_error IS NULL AND (sg_clay_0_30 IS NOT NULL OR sg_sand_0_30 IS NOT NULL)""",
}

_CLIMATE_COLUMNS = "".join(
    f"CAST(json_extract_string(body, '$.properties.parameter.{p}.{m}') AS DOUBLE) AS \"{p}_{m}\",\n         "
    for p in ("T2M", "PRECTOTCORR")
    for m in ("JAN", "OCT", "ANN")
)
_VIEWS["climate"] = _VIEWS["climate"].replace("{params}", _CLIMATE_COLUMNS)
_CLIMATE_NAMES = ", ".join(f'"{p}_{m}"' for p in ("T2M", "PRECTOTCORR") for m in ("JAN", "OCT", "ANN"))


def _r(expr: str, name: str, digits: int = 4) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def _rs(names: str, digits: int = 4) -> str:
    return ", ".join(_r(n, n, digits) for n in names.split())


_SCORES = (
    "count(*) AS n, "
    + _r("1 - sum(squared_error) / (var_pop(observed) * count(*))", "r2")
    + ", " + _r("sqrt(avg(squared_error))", "rmse")
    + ", " + _r("avg(abs_error)", "mae")
)
_MODEL = (
    _SCORES
    + ", " + _r("avg(observed)", "mean_observed")
    + ", " + _r("avg(predicted)", "mean_predicted")
    + ", " + _r("avg(residual)", "mean_residual")
)
_STD = _r("stddev_samp(residual)", "residual_std")
_MAE = _r("avg(abs_error)", "mean_abs_error")


def _binned(source: str, edge_source: str, column: str, q: int, by: str = "", where: str = "true") -> str:
    """Rows of ``source`` with their right-closed quantile bin among distinct edges."""
    probs = ", ".join(f"CAST({i} AS DOUBLE) / {q}" for i in range(q + 1))
    group = f"GROUP BY {by}" if by else ""
    select = f"{by}, " if by else ""
    join = f"JOIN e USING ({by})" if by else "CROSS JOIN e"
    return f"""
  SELECT s.*, e.edges,
         greatest(len(list_filter(e.edges, lambda x: x < s.{column})) - 1, 0) AS bin
  FROM (SELECT * FROM {source}) s {join.replace('e USING', f'''(
    SELECT {select}list_sort(list_distinct(quantile_cont(CAST({column} AS DOUBLE), [{probs}]))) AS edges
    FROM {edge_source} WHERE {where} {group}) e USING''').replace('CROSS JOIN e', f'''CROSS JOIN (
    SELECT list_sort(list_distinct(quantile_cont(CAST({column} AS DOUBLE), [{probs}]))) AS edges
    FROM {edge_source} WHERE {where}) e''')}
  WHERE s.{column} >= e.edges[1] AND s.{column} <= e.edges[-1]"""


_LABEL = "printf(CASE WHEN bin = 0 THEN '[%.3f, %.3f]' ELSE '(%.3f, %.3f]' END, edges[bin + 1], edges[bin + 2])"
_BIN_REPORT = (
    f"any_value({_LABEL}) AS bin_label, count(*) AS n, "
    "min(observed) AS observed_min, max(observed) AS observed_max, "
    + ", ".join(_r(f"avg({c})", f"{c}_mean") for c in ("observed", "predicted", "residual", "abs_error", "squared_error"))
    + ", " + _r("stddev_samp(residual)", "residual_std")
)


def _statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["read_table"] = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
    s["write_table"] = "SELECT * FROM points"
    s["read_model_ready"] = """SELECT row_id, crop, suitability, qty, ext, sg_clay_0_30, sg_sand_0_30, is_wheat FROM prepared"""
    s["write_model_ready"] = """SELECT row_id, lat, lon, crop, suitability, qty, ext, sg_clay_0_30, sg_sand_0_30, is_wheat FROM prepared"""
    s["split_by_category_sink"] = "SELECT row_id, crop, suitability FROM points WHERE crop = 'wheat'"
    s["read_predictions"] = "SELECT * FROM predictions"
    s["read_predictions_lenient"] = f"SELECT 'X' AS model, fold, {_SCORES} FROM predictions GROUP BY fold"
    s["read_run_metrics"] = f"""SELECT run_name, model_name, spatial_block_deg,
        {_rs('spatial_r2_mean spatial_r2_std spatial_rmse_mean spatial_rmse_std spatial_mae_mean spatial_mae_std')},
        spatial_n_splits FROM runs"""
    s["best_run_per_block"] = s["read_run_metrics"] + """
        QUALIFY row_number() OVER (PARTITION BY spatial_block_deg ORDER BY runs.spatial_r2_mean DESC, run_name) = 1"""
    s["read_predictions_lenient_file"] = f"SELECT model, fold, {_SCORES} FROM predictions GROUP BY model, fold"
    s["cell_identifier"] = """SELECT row_id, concat(crop, '_', CAST(CAST(floor((75 - lat) / 2) AS BIGINT) AS VARCHAR), '_',
        CAST(CAST(floor((lon + 180) / 2) AS BIGINT) AS VARCHAR)) AS cell FROM points"""
    s["best_run_of_block"] = f"""SELECT run_name, CASE spatial_block_deg WHEN 5 THEN '5p0' ELSE '10p0' END AS label, {_r('spatial_rmse_mean', 'spatial_rmse_mean')}
        FROM runs QUALIFY row_number() OVER (PARTITION BY spatial_block_deg ORDER BY spatial_r2_mean DESC, run_name) = 1"""
    s["ingest_climatology_single_numbers"] = """SELECT cell_id, power_lon, power_lat, power_elevation_m,
        CASE WHEN power_error IS NULL THEN CAST(CAST(split_part(cell_id, '_', 2) AS BIGINT) % 50 AS DOUBLE) END AS "SNODP",
        "T2M_ANN", "PRECTOTCORR_ANN", power_error FROM climate"""
    s["ingest_climatology"] = "SELECT * FROM climate"
    s["flatten_climatology"] = f"""
        SELECT cell_id, attempt,
               CAST(json_extract_string(body, '$.geometry.coordinates[0]') AS DOUBLE) AS power_lon,
               CAST(json_extract_string(body, '$.geometry.coordinates[1]') AS DOUBLE) AS power_lat,
               CAST(json_extract_string(body, '$.properties.elevation') AS DOUBLE) AS power_elevation_m,
               {_CLIMATE_COLUMNS.rstrip().rstrip(',')}
        FROM climate_responses WHERE status = 200"""
    s["grid_to_points"] = """
        SELECT grid_id, r AS row, c AS col, 75 + (r + CAST(0.5 AS DOUBLE)) * -2 AS lat,
               -180 + (c + CAST(0.5 AS DOUBLE)) * 2 AS lon, value AS suitability
        FROM grid_cells WHERE value <> 300"""
    s["resolve_columns"] = "SELECT row_id, lat, lon, suitability AS target, crop FROM points"
    s["select_by_keyword"] = "SELECT row_id, sg_clay_0_30, sg_sand_0_30 FROM points"
    s["select_by_affix"] = s["select_by_keyword"]
    s["require_columns"] = "SELECT cell_id, lat, lon FROM points"
    s["drop_columns"] = "SELECT row_id, crop, suitability, qty, ext, sg_clay_0_30, sg_sand_0_30 FROM points"
    s["keep_numeric"] = "SELECT row_id, lat, lon, suitability, qty, ext, sg_clay_0_30, sg_sand_0_30 FROM points"
    s["drop_failed_rows"] = "SELECT row_id, suitability FROM points WHERE power_error IS NULL"
    s["drop_all_missing"] = """SELECT row_id, sg_clay_0_30, sg_sand_0_30 FROM points
        WHERE sg_clay_0_30 IS NOT NULL OR sg_sand_0_30 IS NOT NULL"""
    s["drop_counts"] = f"""
        SELECT 'failed' AS step, count(power_error) AS dropped, {_r('count(power_error) / count(*)', 'rate', 8)} FROM points
        UNION ALL
        SELECT 'bare', count(*) FILTER (sg_clay_0_30 IS NULL AND sg_sand_0_30 IS NULL),
               {_r('count(*) FILTER (sg_clay_0_30 IS NULL AND sg_sand_0_30 IS NULL) / count(*)', 'rate', 8)}
        FROM points WHERE power_error IS NULL"""
    s["dropna_subset"] = "SELECT row_id, qty, sg_clay_0_30 FROM points WHERE qty IS NOT NULL AND sg_clay_0_30 IS NOT NULL"
    s["finite_filter"] = """SELECT row_id, lat, lon, ext AS measure FROM points
        WHERE ext IS NOT NULL AND row_id % 19 <> 0 AND row_id % 23 <> 0"""
    s["category_filter"] = "SELECT row_id, 'Wheat' AS crop FROM points WHERE crop = 'wheat'"
    s["coerce_numeric"] = "SELECT row_id, CASE WHEN row_id % 13 <> 0 THEN CAST(suitability AS DOUBLE) END AS score FROM points"
    s["assert_no_missing"] = "SELECT row_id, lat, lon, suitability FROM points"
    s["enrich_left"] = """SELECT p.cell_id, p.crop, p.suitability, c.power_lon, c.power_lat, c.power_elevation_m, c."T2M_ANN", c.power_error
        FROM points p LEFT JOIN climate c ON c.cell_id = p.cell_id"""
    s["enrich_climatology"] = """SELECT p.cell_id, p.crop, CASE WHEN row_id % 31 <> 0 THEN lat END AS lat, lon,
        CASE WHEN row_id % 31 <> 0 THEN c."T2M_ANN" END AS "T2M_ANN",
        CASE WHEN row_id % 31 = 0 THEN 'NaN lat/lon' ELSE c.power_error END AS power_error
        FROM points p LEFT JOIN climate c ON c.cell_id = p.cell_id"""
    s["sample_grid_at_points"] = """SELECT row_id, lat, lon, CAST(v1 AS DOUBLE) AS "0-5cm", CAST(v2 AS DOUBLE) AS "5-15cm",
        CAST(v3 AS DOUBLE) AS "15-30cm" FROM sampled"""
    cells = " ".join(
        f"LEFT JOIN grid_cells g{i} ON g{i}.grid_id = '{g}' AND g{i}.value <> 300 AND g{i}.r = floor((lat - 75) / -2) AND g{i}.c = floor((lon + 180) / 2)"
        for i, g in enumerate(("0-5cm", "5-15cm", "15-30cm"), 1)
    )
    s["sample_tiled_grid"] = f"""SELECT station, lat, lon, CAST(g1.value AS DOUBLE) AS "0-5cm", CAST(g2.value AS DOUBLE) AS "5-15cm",
        CAST(g3.value AS DOUBLE) AS "15-30cm"
        FROM (SELECT s_suppkey AS station, CASE WHEN s_suppkey % 13 <> 0 THEN CAST(12.25 AS DOUBLE) + (s_suppkey * 7 % 16) * CAST(0.25 AS DOUBLE) END AS lat,
                     CAST(20.125 AS DOUBLE) + (s_suppkey * 11 % 16) * CAST(0.25 AS DOUBLE) AS lon FROM supplier) p {cells}"""
    weighted = " + ".join(
        f"CAST(v{i} AS DOUBLE) / 10 * (CAST({w} AS DOUBLE) / 30)" for i, w in ((1, 5), (2, 10), (3, 15))
    )
    s["depth_weighted_mean"] = f"SELECT row_id, {_r(weighted, 'sg_clay_0_30', 6)} FROM sampled"
    scores = ("SELECT fold, count(*) AS n_test, 1 - sum(squared_error) / (var_pop(observed) * count(*)) AS r2, "
              "sqrt(avg(squared_error)) AS rmse, avg(abs_error) AS mae FROM predictions WHERE model = '{m}' GROUP BY fold")
    sides = ", ".join(
        f"{x}.n_test AS n_test_{x}, " + ", ".join(_r(f"{x}.{c}", f"{c}_{x}") for c in ("r2", "rmse", "mae")) for x in "ab"
    )
    s["pair_models"] = f"""SELECT a.fold, {sides} FROM ({scores.format(m='A')}) a JOIN ({scores.format(m='B')}) b ON a.fold = b.fold"""
    s["align_tables"] = "SELECT row_id, qty, suitability, crop, lat, lon FROM points"
    s["category_bin_grid"] = """
        SELECT g.crop, CAST(g.bin AS INTEGER) AS bin, n
        FROM (SELECT * FROM (VALUES ('wheat'), ('maize')) a(crop), range(11) b(bin)) g
        LEFT JOIN (SELECT crop, CAST(floor(suitability / 1000) AS INTEGER) AS bin, count(*) AS n FROM points GROUP BY 1, 2) t ON t.crop = g.crop AND t.bin = g.bin"""
    s["union_all"] = """SELECT row_id, crop, qty, CAST(NULL AS INTEGER) AS suitability FROM points WHERE crop = 'wheat'
        UNION ALL SELECT row_id, crop, NULL, suitability FROM points WHERE crop = 'maize'"""
    s["encode_category"] = """
        SELECT row_id, CASE WHEN row_id % 5 = 0 THEN upper(crop[1]) || crop[2:] WHEN row_id % 7 <> 0 THEN crop END AS crop,
               CAST(crop = 'wheat' AND (row_id % 5 = 0 OR row_id % 7 <> 0) AS INTEGER) AS is_wheat FROM points"""
    block = "concat(CAST(CAST(floor((lat + 90) / {d}) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor((lon + 180) / {d}) AS BIGINT) AS VARCHAR))"
    s["spatial_block"] = f"""SELECT row_id, {block.format(d='CAST(2 AS DOUBLE)')} AS block_2,
        {block.format(d='CAST(0.5 AS DOUBLE)')} AS block_05 FROM points"""
    s["clip_target"] = """SELECT row_id, CASE WHEN row_id % 29 <> 0 THEN
        CASE WHEN suitability * 2 - 3000 < 0 THEN 0 WHEN suitability * 2 - 3000 > 10000 THEN 10000
             ELSE suitability * 2 - 3000 END END AS clipped FROM points"""
    s["with_residuals"] = "SELECT model, row_index, observed, predicted, residual, abs_error, squared_error FROM predictions"
    s["feature_group_prefix"] = """SELECT feature, count(*) AS n,
        CASE feature WHEN 'is_wheat' THEN 'Crop indicator' WHEN 'T2M_OCT' THEN 'Climate variables' WHEN 'WS2M_ANN' THEN 'Climate variables'
             WHEN 'sg_clay_0_30' THEN 'Soil variables' ELSE 'Other variables' END AS feature_group
        FROM contributions GROUP BY feature"""
    s["feature_group_keyword"] = """SELECT feature, count(*) AS n,
        CASE feature WHEN 'is_wheat' THEN 'crop_indicator' WHEN 'T2M_OCT' THEN 'soil' WHEN 'WS2M_ANN' THEN 'climate'
             WHEN 'sg_clay_0_30' THEN 'soil' ELSE 'other' END AS feature_group
        FROM contributions GROUP BY feature"""
    s["regression_metrics"] = f"SELECT {_SCORES} FROM predictions"
    s["metrics_by_fold"] = f"SELECT model, fold, {_SCORES.replace('AS n,', 'AS n_test,')} FROM predictions GROUP BY model, fold"
    s["write_reports"] = s["metrics_by_fold"]
    s["publish_reports_csv"] = s["metrics_by_fold"]
    s["metrics_by_model"] = f"SELECT model, {_MODEL}, {_STD}, {_MAE} FROM predictions GROUP BY model"
    s["metrics_by_model_category"] = f"SELECT model, crop, {_MODEL}, {_STD}, {_MAE} FROM predictions GROUP BY model, crop"
    s["metrics_all_levels"] = f"""
        SELECT model, crop, {_MODEL}, {_STD}, {_MAE}, 'category' AS level FROM predictions GROUP BY model, crop
        UNION ALL SELECT model, NULL, {_MODEL}, {_STD}, {_MAE}, 'model' FROM predictions GROUP BY model"""
    s["subgroup_metrics"] = f"SELECT crop, {_MODEL}, {_MAE} FROM predictions GROUP BY crop"
    means = ", ".join(
        _r(f"avg({m})", f"{m}_mean") + ", " + _r(f"stddev_samp({m})", f"{m}_std") for m in ("r2", "rmse", "mae")
    )
    s["cv_summary"] = f"""SELECT model, {means}, count(*) AS n_splits FROM (
        SELECT model, fold, 1 - sum(squared_error) / (var_pop(observed) * count(*)) AS r2, sqrt(avg(squared_error)) AS rmse,
               avg(abs_error) AS mae FROM predictions GROUP BY model, fold) t GROUP BY model"""
    s["cv_report"] = f"""SELECT f.*, p.n, p.r2 AS overall_cv_r2, p.rmse AS overall_cv_rmse, p.mae AS overall_cv_mae
        FROM ({s['cv_summary']}) f JOIN (SELECT model, {_SCORES} FROM predictions GROUP BY model) p ON p.model = f.model"""
    s["error_by_observed_bin"] = f"""SELECT model, CAST(bin AS INTEGER) AS bin, {_BIN_REPORT}
        FROM ({_binned('predictions', 'predictions', 'observed', 5)}) t GROUP BY model, bin"""
    s["error_by_observed_bin_single"] = f"""SELECT model, CAST(bin AS INTEGER) AS bin, {_BIN_REPORT}
        FROM ({_binned('predictions', 'predictions', 'observed', 5, 'model')}) t GROUP BY model, bin"""
    s["error_line_series"] = f"""SELECT model, CAST(bin AS INTEGER) AS bin,
        {', '.join(_r(f'avg({c})', f'{c}_mean') for c in ('observed', 'abs_error', 'residual'))}
        FROM ({_binned('predictions', 'predictions', 'observed', 5)}) t GROUP BY model, bin"""
    s["mae_by_reference_bin"] = f"""SELECT CAST(bin AS INTEGER) AS bin, ['Lowest', 'Low-mid', 'Middle', 'High-mid', 'Highest'][bin + 1] AS bin_label,
        round(avg(abs_error) FILTER (model = 'A'), 2) AS "mae_A", round(avg(abs_error) FILTER (model = 'B'), 2) AS "mae_B"
        FROM ({_binned('predictions', 'predictions', 'observed', 5, where="model = 'A'")}) t GROUP BY bin"""
    binned = _binned('predictions', 'predictions', 'observed', 5, where="model = 'A'")
    s["mae_by_reference_bin_long"] = f"""
        SELECT CAST(g.bin AS INTEGER) AS bin, ['Lowest', 'Low-mid', 'Middle', 'High-mid', 'Highest'][g.bin + 1] AS bin_label, g.model, x.mae
        FROM (SELECT * FROM range(5) b(bin), (VALUES ('A'), ('B'), ('high')) n(model)) g
        LEFT JOIN (SELECT bin, model, round(avg(abs_error), 2) AS mae FROM (
            SELECT bin, model, abs_error FROM ({binned}) t
            UNION ALL SELECT bin, 'high', abs_error FROM ({binned}) t WHERE model = 'B' AND observed > 3000) m GROUP BY ALL) x ON x.bin = g.bin AND x.model = g.model"""
    s["plot_extent"] = """SELECT model, least(min(observed), min(predicted)) AS extent_min,
        greatest(max(observed), max(predicted)) AS extent_max FROM predictions GROUP BY model"""
    s["missing_profile"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(100.0 * CAST(count(*) - count({c}) AS DOUBLE) / count(*), 6) AS missing_pct FROM points"""
        for c in ("sg_clay_0_30", "sg_sand_0_30", "qty", "power_error", "crop")
    )
    s["value_counts"] = "SELECT power_error, count(*) AS n FROM points GROUP BY power_error"
    s["distinct_counts"] = f"""SELECT 'block_id' AS "column", count(DISTINCT {block.format(d='CAST(2 AS DOUBLE)')}) AS n_distinct FROM points
        UNION ALL SELECT 'crop', count(DISTINCT crop) FROM points
        UNION ALL SELECT 'sg_clay_0_30', count(DISTINCT sg_clay_0_30) FROM points"""
    pcts = ", ".join(_r(f"quantile_cont(CAST(suitability AS DOUBLE), {p / 100})", f"p{p}") for p in (10, 25, 50, 75, 90))
    s["describe_target"] = f"""SELECT crop, count(suitability) AS count, {_r('avg(suitability)', 'mean')}, {_r('stddev_samp(suitability)', 'std')},
        min(suitability) AS min, {pcts}, max(suitability) AS max FROM points GROUP BY crop"""
    s["zero_rate"] = f"""SELECT crop, count(*) AS n, {_r('avg(CAST(suitability = 0 AS INTEGER))', 'zero_rate', 8)},
        CAST(0.2 AS DOUBLE) AS expected_rate FROM points GROUP BY crop"""
    s["median_impute"] = "SELECT row_id, " + ", ".join(
        f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in ("sg_clay_0_30", "sg_sand_0_30", "qty")
    ) + " FROM points"
    s["corr_with_target"] = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {_r(f'corr({c}, suitability)', 'corr_with_target', 6)} FROM points"
        for c in ("qty", "ext", "sg_clay_0_30", "sg_sand_0_30", "suitability")
    )
    ok, bare = "power_error IS NULL", "sg_clay_0_30 IS NULL AND sg_sand_0_30 IS NULL"
    kept = f"power_error IS NULL AND NOT ({bare})"
    s["prep_report"] = f"""
        SELECT count(*) AS n_rows_in, 12 AS n_cols_in, count(*) FILTER ({kept}) AS n_rows_out,
               count(power_error) AS dropped_failed_rows, {_r('count(power_error) / count(*)', 'dropped_failed_rate', 6)},
               count(*) FILTER ({ok} AND {bare}) AS dropped_all_missing_rows,
               {_r(f'count(*) FILTER ({ok} AND {bare}) / count(*) FILTER ({ok})', 'dropped_all_missing_rate', 6)},
               CAST(min(suitability) FILTER ({kept}) AS DOUBLE) AS target_min, CAST(max(suitability) FILTER ({kept}) AS DOUBLE) AS target_max,
               {_r(f'100 * count(*) FILTER ({ok} AND sg_clay_0_30 IS NULL) / count(*) FILTER ({ok})', 'before_sg_clay_0_30', 6)},
               {_r(f'100 * count(*) FILTER ({ok} AND sg_sand_0_30 IS NULL) / count(*) FILTER ({ok})', 'before_sg_sand_0_30', 6)},
               CAST(0 AS DOUBLE) AS after_sg_clay_0_30, CAST(0 AS DOUBLE) AS after_sg_sand_0_30
        FROM points"""
    s["histogram"] = f"""
        SELECT g.model, CAST(b AS INTEGER) AS bin, {_r('-6000 + b * 300', 'bin_lo')}, {_r('-6000 + (b + 1) * 300', 'bin_hi')},
               (SELECT count(*) FROM predictions p WHERE p.model = g.model
                  AND p.residual >= -6000 + b * 300 AND (p.residual < -6000 + (b + 1) * 300 OR (b = 39 AND p.residual = 6000))) AS n
        FROM (SELECT DISTINCT model FROM predictions) g, range(40) t(b)"""

    def own_range(source: str, by: str, column: str, bins: int) -> str:
        return f"""
        SELECT g.{by}, CAST(b AS INTEGER) AS bin, {_r(f'lo + b * ((hi - lo) / {bins})', 'bin_lo')},
               {_r(f'lo + (b + 1) * ((hi - lo) / {bins})', 'bin_hi')}, coalesce(n, 0) AS n
        FROM (SELECT {by}, CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {source} GROUP BY {by}) g
        CROSS JOIN range({bins}) t(b)
        LEFT JOIN (SELECT p.{by}, least({bins - 1}, floor((p.{column} - l.lo) / ((l.hi - l.lo) / {bins}))) AS k, count(*) AS n
                   FROM {source} p JOIN (SELECT {by}, CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi
                                         FROM {source} GROUP BY {by}) l ON l.{by} = p.{by} GROUP BY 1, 2) c
          ON c.{by} = g.{by} AND c.k = b"""

    s["histogram_minmax"] = own_range("points", "crop", "suitability", 60)
    s["residual_histogram"] = own_range("predictions", "model", "residual", 70)
    s["boxplot_stats"] = """
        SELECT q.crop, q.n, min(ext) FILTER (ext >= q1 - 1.5 * (q3 - q1)) AS whisker_low, q1, median, q3,
               max(ext) FILTER (ext <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
               format('{}{} (n = {:,})', upper(q.crop[1]), q.crop[2:], q.n) AS label
        FROM points p JOIN (SELECT crop, count(ext) AS n, quantile_cont(ext, 0.25) AS q1, quantile_cont(ext, 0.5) AS median,
                                   quantile_cont(ext, 0.75) AS q3 FROM points GROUP BY crop) q ON q.crop = p.crop
        GROUP BY q.crop, q.n, q1, median, q3"""
    s["stratified_sample"] = f"""
        SELECT row_id, cell_id, crop, lat, lon, suitability
        FROM (SELECT *, row_number() OVER (PARTITION BY crop, stratum ORDER BY md5(concat('42|', CAST(row_id AS VARCHAR))), row_id) AS k,
                     count(*) OVER (PARTITION BY crop, stratum) AS size
              FROM (SELECT row_id, cell_id, crop, lat, lon, suitability, bin + 1 AS stratum
                    FROM ({_binned('points', 'points', 'suitability', 8, 'crop', 'suitability > 0')}) t WHERE suitability > 0
                    UNION ALL SELECT row_id, cell_id, crop, lat, lon, suitability, 0 FROM points WHERE suitability = 0) u) v
        WHERE k <= CASE WHEN stratum = 0 THEN 8 WHEN stratum <= 3 THEN 51 ELSE 50 END"""
    pick = "md5(concat('42|', CAST({k} AS VARCHAR)))"
    s["sample_exact_n"] = f"""SELECT row_id, suitability, qty FROM points
        QUALIFY row_number() OVER (ORDER BY {pick.format(k='row_id')}) <= 1000"""
    s["sample_per_group"] = f"""SELECT model, row_index, observed, predicted FROM predictions
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY {pick.format(k='row_index')}) <= 700"""
    s["random_split"] = f"""SELECT row_id, suitability,
        row_number() OVER (ORDER BY {pick.format(k='row_id')}) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_test FROM points"""
    s["quantile_bins"] = f"""SELECT row_id, crop, suitability, CAST(bin AS INTEGER) AS bin, edges[bin + 1] AS bin_lo, edges[bin + 2] AS bin_hi
        FROM ({_binned("(SELECT * FROM points WHERE suitability > 0)", 'points', 'suitability', 8, 'crop', 'suitability > 0')}) t"""
    s["cut_by_edges"] = """SELECT row_id, suitability, CASE WHEN suitability <= 1000 THEN 'low' WHEN suitability <= 2500 THEN 'mid'
        WHEN suitability <= 5000 THEN 'high' WHEN suitability <= 9000 THEN 'top' END AS band FROM points"""
    s["exact_quantiles"] = f"""SELECT crop, count(ext) AS n, {_r('quantile_cont(ext, 0.1)', 'q0', 6)}, {_r('quantile_cont(ext, 0.5)', 'q1', 6)},
        {_r('quantile_cont(ext, 0.99)', 'q2', 6)} FROM points GROUP BY crop"""
    s["group_kfold"] = "SELECT row_id, block_id, fold FROM folded"
    s["fold_means"] = f"""
        SELECT fold, CAST(sum(n) OVER () - n AS BIGINT) AS n_train, n AS n_test,
               {_r('(sum(s) OVER () - s) / (sum(n) OVER () - n)', 'train_mean_prediction')}, {_r('s / n', 'test_mean_observed')}
        FROM (SELECT CAST(row_id % 5 + 1 AS INTEGER) AS fold, count(*) AS n, CAST(sum(suitability) AS DOUBLE) AS s FROM points GROUP BY 1) t"""
    s["mean_baseline_cv"] = f"SELECT model, fold, n_test, {_rs('r2 rmse mae')} FROM baseline_scores"
    s["mean_baseline_folds"] = f"""
        SELECT b.fold, {_rs('r2 rmse mae')}, CAST(t.n - b.n_test AS BIGINT) AS n_train, b.n_test,
               {_r('p.predicted', 'train_mean_prediction')}, {_r('p.seen', 'test_mean_observed')}
        FROM baseline_scores b JOIN (SELECT fold, any_value(predicted) AS predicted, avg(observed) AS seen FROM baseline GROUP BY fold) p
          ON p.fold = b.fold, (SELECT count(*) AS n FROM points) t"""
    s["mean_baseline_summary"] = f"SELECT model, {means}, count(*) AS n_splits FROM baseline_scores GROUP BY model"
    s["paired_deltas"] = f"SELECT crop, fold, metric, {_r('difference', 'difference')} FROM deltas"
    s["paired_tests"] = f"""
        WITH r AS (
          SELECT crop, metric, fold, difference AS d,
                 rank() OVER (PARTITION BY crop, metric ORDER BY abs(difference)) AS rk,
                 row_number() OVER (PARTITION BY crop, metric ORDER BY fold) - 1 AS k
          FROM deltas),
        b AS (
          SELECT crop, metric, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, sum(rk) FILTER (d > 0) AS plus,
                 sum(rk) FILTER (d < 0) AS minus, bool_and(d > 0) AS every
          FROM r GROUP BY crop, metric),
        signs AS (
          SELECT crop, metric, s, coalesce(sum(rk) FILTER ((s >> k) & 1 = 1), 0) AS w
          FROM r, range(32) t(s) GROUP BY crop, metric, s),
        p AS (
          SELECT b.crop, b.metric, count(*) FILTER (w >= coalesce(plus, 0)) / 32.0 AS hi, count(*) FILTER (w <= coalesce(plus, 0)) / 32.0 AS lo
          FROM b JOIN signs USING (crop, metric) GROUP BY ALL),
        t AS (
          SELECT *, mean / (sd / sqrt(n)) AS tt,
                 1 - sin(atan(abs(mean / (sd / sqrt(n))) / 2)) * (1 + pow(cos(atan(abs(mean / (sd / sqrt(n))) / 2)), 2) / 2) AS p2
          FROM b JOIN p USING (crop, metric))
        SELECT crop, metric, n AS n_folds, {_r('mean', 'mean_difference')}, {_r('sd', 'sd_difference')}, {_r('mean / sd', 'cohen_dz')},
               {_r('tt', 't_stat')}, {_r('p2', 't_p_two_sided')}, {_r('CASE WHEN tt >= 0 THEN p2 / 2 ELSE 1 - p2 / 2 END', 't_p_one_sided')},
               {_r('least(coalesce(plus, 0), coalesce(minus, 0))', 'wilcoxon_stat_two_sided')},
               {_r('CASE WHEN coalesce(plus, 0) = 7 THEN 1 ELSE least(1, 2 * least(hi, lo)) END', 'wilcoxon_p_two_sided')},
               {_r('coalesce(plus, 0)', 'wilcoxon_stat_one_sided')}, {_r('hi', 'wilcoxon_p_one_sided')}, every AS all_differences_positive
        FROM t"""
    s["mean_abs_contribution"] = f"SELECT feature, {_rs('mean_abs_contrib importance_pct')} FROM importances"
    s["contribution_by_category"] = f"""
        SELECT crop, feature, {_r('m', 'mean_abs_contrib')}, {_r('100 * m / sum(m) OVER (PARTITION BY crop)', 'importance_pct')}
        FROM (SELECT crop, feature, avg(abs(contribution)) AS m FROM contributions GROUP BY crop, feature) t"""
    s["group_importance"] = f"""
        SELECT feature_group, {_r('total', 'total_importance')}, n_features, {_r('total / sum(total) OVER ()', 'share')}
        FROM (SELECT CASE feature WHEN 'is_wheat' THEN 'crop_indicator' WHEN 'WS2M_ANN' THEN 'climate'
                     WHEN 'power_elevation_m' THEN 'other' ELSE 'soil' END AS feature_group,
                     sum(mean_abs_contrib) AS total, count(*) AS n_features FROM importances GROUP BY 1) t"""
    s["indicator_contribution_summary"] = f"""
        SELECT count(*) > 0 AS feature_present, {_r('avg(contribution)', 'overall_mean_contrib')},
               {_r('avg(abs(contribution))', 'overall_mean_abs_contrib')},
               count(*) FILTER (value = 1) AS rows_when_1, count(*) FILTER (value = 0) AS rows_when_0,
               {_r('avg(contribution) FILTER (value = 1)', 'mean_contrib_when_1')}, {_r('avg(contribution) FILTER (value = 0)', 'mean_contrib_when_0')},
               {_r('avg(abs(contribution)) FILTER (value = 1)', 'mean_abs_contrib_when_1')},
               {_r('avg(abs(contribution)) FILTER (value = 0)', 'mean_abs_contrib_when_0')}
        FROM contributions WHERE feature = 'is_wheat'"""
    s["save_load_model"] = "SELECT row_id, CAST(suitability AS DOUBLE) AS label, true AS same FROM prepared"
    s["oof_coverage"] = """SELECT row_id, crop, fold, CAST(suitability AS DOUBLE) AS observed, true AS in_range, true AS consistent
        FROM folded"""
    s["contribution_additivity"] = "SELECT row_id, crop, CAST(0 AS DOUBLE) AS gap FROM prepared"
    s["bias_summary"] = f"SELECT {_r('avg(predicted)', 'mean_bias')}, {_r('stddev_pop(predicted)', 'std_bias')} FROM predictions"
    s["top_k_features"] = f"""SELECT feature, {_rs('mean_abs_contrib importance_pct')} FROM importances
        ORDER BY importances.mean_abs_contrib DESC, feature LIMIT 3"""
    return s


def _cuts(prefix: str, train: str) -> dict[str, str]:
    """Views that find the best single cut of each job's training rows (job, min_leaf, row_id, y)."""
    return {
        f"{prefix}_sums": f"""
  SELECT job, min_leaf, place, feature, v, count(*) AS n, sum(y) AS s
  FROM {train} JOIN cut_values ON cut_values.id = {train}.row_id GROUP BY ALL""",
        f"{prefix}_best": f"""
  SELECT job, feature, place, v, (v + next_v) / 2 AS threshold, all_n, left_s / left_n AS low,
         (all_s - left_s) / (all_n - left_n) AS high, all_s / all_n AS mean,
         left_s * left_s / left_n + (all_s - left_s) * (all_s - left_s) / (all_n - left_n) - all_s * all_s / all_n AS fall
  FROM (SELECT *, sum(n) OVER up AS left_n, sum(s) OVER up AS left_s, lead(v) OVER up AS next_v,
               sum(n) OVER (PARTITION BY job, place) AS all_n, sum(s) OVER (PARTITION BY job, place) AS all_s
        FROM {prefix}_sums WINDOW up AS (PARTITION BY job, place ORDER BY v)) t
  WHERE next_v IS NOT NULL AND left_n >= min_leaf AND all_n - left_n >= min_leaf
  QUALIFY row_number() OVER (PARTITION BY job ORDER BY fall DESC, place, v) = 1""",
    }


_VIEWS |= {
    "cut_points": """
  SELECT row_id, crop, lat, lon, fold, CAST(suitability AS DOUBLE) AS y, CAST(coalesce(n_lines, 0) AS DOUBLE) AS n_lines,
         coalesce(sg_clay_0_30, 0) AS clay, coalesce(sg_sand_0_30, 0) AS sand, CAST(crop = 'wheat' AS DOUBLE) AS wheat,
         row_number() OVER (ORDER BY md5(concat('42|', CAST(row_id AS VARCHAR)))) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS test
  FROM folded""",
    "cut_values": """
  SELECT row_id AS id, 0 AS place, 'n_lines' AS feature, n_lines AS v FROM cut_points
  UNION ALL SELECT row_id, 1, 'sg_clay_0_30', clay FROM cut_points
  UNION ALL SELECT row_id, 2, 'sg_sand_0_30', sand FROM cut_points
  UNION ALL SELECT row_id, 3, 'is_wheat', wheat FROM cut_points""",
    "cut_train": """
  SELECT concat('fold', CAST(k AS VARCHAR), '_', CAST(m AS VARCHAR)) AS job, m AS min_leaf, row_id, y
  FROM cut_points, range(1, 6) t(k), (VALUES (1), (400)) u(m) WHERE fold <> k
  UNION ALL SELECT 'all', 1, row_id, y FROM cut_points
  UNION ALL SELECT 'train', 1, row_id, y FROM cut_points WHERE NOT test""",
    **_cuts("first", "cut_train"),
    # Twice the residual: the negative gradient of the squared error.
    "cut_rest": """
  SELECT t.job, t.min_leaf, t.row_id, 2 * (t.y - CASE WHEN x.v <= b.v THEN b.low ELSE b.high END) AS y
  FROM cut_train t JOIN first_best b ON b.job = t.job JOIN cut_values x ON x.id = t.row_id AND x.feature = b.feature""",
    **_cuts("second", "cut_rest"),
    "cut_scored": """
  SELECT j.job, p.row_id, p.crop, p.lat, p.lon, p.fold, p.test, p.y AS observed,
         CASE WHEN x1.v <= b1.v THEN b1.low ELSE b1.high END AS one,
         CASE WHEN x1.v <= b1.v THEN b1.low ELSE b1.high END + CASE WHEN x2.v <= b2.v THEN b2.low ELSE b2.high END AS two
  FROM cut_points p JOIN (SELECT DISTINCT job FROM cut_train) j ON j.job IN ('all', 'train') OR starts_with(j.job, concat('fold', CAST(p.fold AS VARCHAR)))
  JOIN first_best b1 ON b1.job = j.job JOIN cut_values x1 ON x1.id = p.row_id AND x1.feature = b1.feature
  JOIN second_best b2 ON b2.job = j.job JOIN cut_values x2 ON x2.id = p.row_id AND x2.feature = b2.feature""",
}


def _error_scores(pred: str) -> str:
    """Unrounded r2, rmse and mae of a prediction column of cut_scored."""
    e = f"(observed - {pred})"
    return f"1 - sum({e} * {e}) / (var_pop(observed) * count(*)) AS r2, sqrt(avg({e} * {e})) AS rmse, avg(abs({e})) AS mae"


def _replayed() -> dict[str, str]:
    """Fitted models of one or two single cuts, replayed."""

    def folds(model: str, pred: str) -> str:
        return f"""SELECT '{model}' AS model, fold, CAST(sum(n) OVER () - n AS BIGINT) AS n_train, n AS n_test, {_rs('r2 rmse mae')}
        FROM (SELECT fold, count(*) AS n, {_error_scores(pred)} FROM cut_scored WHERE job = concat('fold', CAST(fold AS VARCHAR), '_1') GROUP BY fold) t"""

    error = "(observed - one)"
    spatial = ", ".join(
        f"{_r(f'avg({m})', f'spatial_{m}_mean')}, {_r(f'stddev_samp({m})', f'spatial_{m}_std')}" for m in ("r2", "rmse", "mae")
    )
    terms = " UNION ALL ".join(
        f"""SELECT x.id, x.feature, CASE WHEN x.v <= b.v THEN b.low ELSE b.high END - b.mean AS part
            FROM {t}_best b JOIN cut_values x ON x.feature = b.feature WHERE b.job = 'all'""" for t in ("first", "second")
    )
    bias = "(SELECT sum(mean) AS bias FROM (SELECT mean FROM first_best WHERE job = 'all' UNION ALL SELECT mean FROM second_best WHERE job = 'all') t)"
    roots = """(SELECT 0 AS tree, * FROM first_best WHERE job = 'all' UNION ALL SELECT 1, * FROM second_best WHERE job = 'all')"""
    return {
        "random_forest_cv_one_cut": folds("forest", "one"),
        "boosted_trees_cv_two_cuts": folds("boosted", "two"),
        "oof_predictions_one_cut": f"""SELECT fold, row_id, crop, {_rs('lat lon observed')}, {_r('one', 'predicted')}, {_r(error, 'residual')},
        {_r(f'abs{error}', 'abs_error')}, {_r(f'{error} * {error}', 'squared_error')}, 'model' AS model
        FROM cut_scored WHERE job = concat('fold', CAST(fold AS VARCHAR), '_1')""",
        "holdout_eval_two_cuts": f"""SELECT n_test, {_rs('r2 rmse mae')}
        FROM (SELECT count(*) AS n_test, {_error_scores('two')} FROM cut_scored WHERE job = 'train' AND test) t""",
        "random_search_one_cut": f"""SELECT concat('rf_leaf', CAST(m AS VARCHAR), '_block10p0_rs') AS run_name, 'RandomForestRegressor' AS model_name,
        CAST(10 AS DOUBLE) AS spatial_block_deg, {spatial}, count(*) AS spatial_n_splits, CAST(5 AS BIGINT) AS n_splits,
        CAST(1 AS BIGINT) AS n_estimators, CAST(1 AS BIGINT) AS max_depth, CAST(m AS BIGINT) AS min_samples_leaf, 'all' AS max_features,
        false AS bootstrap, CAST(4 AS BIGINT) AS n_features_used, any_value(total) AS n_rows
        FROM (SELECT CAST(split_part(job, '_', 2) AS INTEGER) AS m, fold, {_error_scores('one')} FROM cut_scored
              WHERE starts_with(job, 'fold') GROUP BY job, fold) t, (SELECT count(*) AS total FROM points) c
        GROUP BY m""",
        "run_folds_one_cut": f"""SELECT concat('rf_leaf', split_part(job, '_', 2), '_block10p0_rs') AS run_name, fold, n_test, {_rs('r2 rmse mae')}
        FROM (SELECT job, fold, count(*) AS n_test, {_error_scores('one')} FROM cut_scored WHERE starts_with(job, 'fold') GROUP BY job, fold) t""",
        "full_fit_two_cuts": f"""SELECT CAST(tree AS INTEGER) AS tree, feature, {_r('threshold', 'threshold')}, CAST(all_n AS BIGINT) AS n_rows,
        {_r('fall / all_n', 'gain')}, CAST(1 AS DOUBLE) AS weight FROM {roots} t""",
        "feature_importance_two_cuts": f"""SELECT feature, {_r('share', 'importance', 6)}, {_r('share', 'share', 6)}
        FROM (SELECT f.feature, coalesce(g.raw, 0) / sum(coalesce(g.raw, 0)) OVER () AS share
              FROM (SELECT DISTINCT feature FROM cut_values) f LEFT JOIN (SELECT feature, avg(fall) AS raw FROM {roots} r GROUP BY feature) g
                ON g.feature = f.feature) t""",
        "tree_contributions_two_cuts": f"""SELECT x.id AS row_id, p.crop, x.feature, {_r('x.v', 'value')}, {_r('coalesce(c.part, 0)', 'contribution')}, {_r('b.bias', 'bias')}
        FROM cut_values x JOIN cut_points p ON p.row_id = x.id
        LEFT JOIN (SELECT id, feature, sum(part) AS part FROM ({terms}) u GROUP BY id, feature) c ON c.id = x.id AND c.feature = x.feature, {bias} b""",
        "bias_summary_of_model": f"SELECT {_r('bias', 'mean_bias')}, CAST(0 AS DOUBLE) AS std_bias FROM {bias} b",
    }


def _needed(text: str) -> list[str]:
    """Views a statement uses, directly or through other views, in definition order."""
    seen: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\b[a-z_]+\b", todo.pop()))
        for name in words & _VIEWS.keys() - seen:
            seen.add(name)
            todo.append(_VIEWS[name])
    return [name for name in _VIEWS if name in seen]


def statements() -> dict[str, str]:
    """Complete statements, each with the views it needs in front."""
    out = {}
    for name, body in (_statements() | _replayed()).items():
        body = body.strip()
        views = [f"{v} AS ({_VIEWS[v]})" for v in _needed(body)]
        if body.startswith("WITH "):
            views.append(body[5:].split("\n        SELECT crop, metric, n AS n_folds", 1)[0].strip().rstrip(","))
            body = "SELECT crop, metric, n AS n_folds" + body.split("SELECT crop, metric, n AS n_folds", 1)[1]
        recursive = "RECURSIVE " if any(v.startswith("greedy AS") for v in views) else ""
        out[name] = f"WITH {recursive}{', '.join(views)}\n{body}" if views else body
    return out
