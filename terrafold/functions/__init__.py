from terrafold.functions.columns import (
    COLUMN_ROLES,
    SOIL_KEYWORDS,
    drop_columns,
    dropped_columns,
    keep_numeric,
    require_columns,
    resolve_columns,
    select_by_affix,
    select_by_keyword,
)
from terrafold.functions.scalars import (
    block_label,
    cell_identifier,
    clip_target,
    count_label,
    encode_category,
    feature_group_keyword,
    feature_group_prefix,
    guarded_share,
    interval_label,
    nan_to_null,
    spatial_block,
    with_residuals,
)

__all__ = [
    "COLUMN_ROLES",
    "SOIL_KEYWORDS",
    "block_label",
    "cell_identifier",
    "clip_target",
    "count_label",
    "drop_columns",
    "dropped_columns",
    "encode_category",
    "feature_group_keyword",
    "feature_group_prefix",
    "guarded_share",
    "interval_label",
    "keep_numeric",
    "nan_to_null",
    "require_columns",
    "resolve_columns",
    "select_by_affix",
    "select_by_keyword",
    "spatial_block",
    "with_residuals",
]
