from terrafold.operators.binning import (
    bin_by_edges,
    cut_by_edges,
    histogram,
    histogram_minmax,
    quantile_bins,
    quantile_edges,
    with_interval_label,
)
from terrafold.operators.compare import paired_deltas, paired_tests
from terrafold.operators.explain import (
    bias_summary,
    contribution_by_category,
    feature_importance,
    group_importance,
    indicator_contribution_summary,
    mean_abs_contribution,
    node_table,
    top_k_features,
    tree_contributions,
)
from terrafold.operators.folds import (
    fold_map,
    fold_means,
    group_kfold,
    mean_baseline_cv,
    mean_baseline_folds,
    spatial_folds,
)
from terrafold.operators.joins import align_tables, category_bin_grid, enrich_left, pair_models, union_all
from terrafold.operators.metrics import (
    cv_report,
    cv_summary,
    error_by_observed_bin,
    error_line_series,
    mae_by_reference_bin,
    metrics_all_levels,
    metrics_by_fold,
    metrics_by_model,
    metrics_by_model_category,
    plot_extent,
    regression_metrics,
    subgroup_metrics,
)
from terrafold.operators.ml import (
    assemble,
    best_run,
    best_run_per_block,
    boosted_trees,
    boosted_trees_cv,
    forest,
    full_fit,
    holdout_eval,
    oof_predictions,
    random_forest_cv,
    random_search,
    run_artifacts,
    run_folds,
    run_importances,
    run_model,
)
from terrafold.operators.prep import (
    Prepared,
    assert_no_missing,
    category_filter,
    coerce_numeric,
    drop_all_missing,
    drop_counts,
    drop_failed_rows,
    dropna_subset,
    finite_filter,
    median_impute,
    median_values,
    missing_profile,
    prep_report,
    prepare,
)
from terrafold.operators.profile import (
    boxplot_stats,
    corr_with_target,
    describe_target,
    distinct_counts,
    value_counts,
    zero_rate,
)
from terrafold.operators.quantiles import exact_quantiles
from terrafold.operators.sampling import (
    hash_cutoffs,
    param_sampler,
    random_split,
    sample_exact_n,
    sample_per_group,
    stratified_sample,
)

__all__ = [name for name in dir() if not name.startswith("_")]
