from terrafold.sources.climate import (
    CLIMATE_PARAMS,
    CLIMATE_PERIODS,
    enrich_climatology,
    flatten_climatology,
    ingest_climatology,
    parse_climatology,
)
from terrafold.sources.grids import (
    GridMeta,
    depth_weighted_mean,
    grid_to_points,
    read_tiles,
    rescale,
    sample_grid_at_points,
    write_tiles,
)
from terrafold.sources.models import load_model, save_model
from terrafold.sources.published import publish_tables, read_published
from terrafold.sources.tables import (
    PREDICTION_SCHEMA,
    read_model_ready,
    read_predictions,
    read_predictions_lenient,
    read_run_metrics,
    read_table,
    split_by_category_sink,
    write_model_ready,
    write_reports,
    write_run_metrics,
    write_table,
)

__all__ = [
    "CLIMATE_PARAMS",
    "CLIMATE_PERIODS",
    "GridMeta",
    "PREDICTION_SCHEMA",
    "depth_weighted_mean",
    "enrich_climatology",
    "flatten_climatology",
    "grid_to_points",
    "ingest_climatology",
    "load_model",
    "parse_climatology",
    "publish_tables",
    "read_model_ready",
    "read_predictions",
    "read_predictions_lenient",
    "read_published",
    "read_run_metrics",
    "read_table",
    "read_tiles",
    "rescale",
    "sample_grid_at_points",
    "save_model",
    "split_by_category_sink",
    "write_model_ready",
    "write_reports",
    "write_run_metrics",
    "write_table",
    "write_tiles",
]
