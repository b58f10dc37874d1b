from tablelens.operators.clean import (
    coerce_dates,
    coerce_numeric,
    date_parse_report,
    dedup,
    dedup_counts,
    dedup_normalised,
    distinct_keys,
    normalise_json,
    normalise_nulls,
    parse_timestamps,
    trim_cells,
)
from tablelens.operators.engagement import (
    available_metrics,
    category_means,
    category_rankings,
    category_share,
    engagement_by_group,
    group_metric_totals,
    page_engagement,
    row_total,
)
from tablelens.operators.groups import (
    drilldown_of,
    first_groups,
    first_rows,
    group_quantiles,
    group_size_stats,
    group_sizes,
    group_sizes_multi,
    group_table,
    grouped_numeric_stats,
    grouping_candidates,
    ranked_group_sizes,
    require_columns,
    restrict_to_groups,
    size_stats_of,
    top_group_drilldown,
    top_groups,
    top_of,
)
from tablelens.operators.ordering import (
    approx_quantiles,
    global_rank,
    quantiles,
)
from tablelens.operators.profile import (
    categorical_profile,
    dataset_overview,
    distinct_counts,
    null_column_count,
    null_counts,
    numeric_profile,
    value_counts,
    value_frequencies,
)
from tablelens.operators.roles import (
    ColumnRoles,
    classify_by_schema,
    classify_columns,
    numeric_ratios,
    role_table,
)

__all__ = [name for name in dir() if not name.startswith("_")]
