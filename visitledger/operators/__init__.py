from visitledger.operators.ageing import (
    aged_detail,
    ageing_matrix,
    date_bounds,
    in_date_range,
    open_total,
)
from visitledger.operators.exclusion import drop_excluded, null_aware_anti
from visitledger.operators.intervals import (
    cover_anti,
    cover_semi,
    covered_points,
    first_cover,
    interval_hits,
    interval_left_join,
    spans_without_points,
)
from visitledger.operators.keys import (
    as_of,
    first_per_key,
    latest_per_key,
    snapshot_dates,
    spread_left_join,
    version_spans,
    versions_on,
)

__all__ = [
    "aged_detail",
    "ageing_matrix",
    "as_of",
    "cover_anti",
    "cover_semi",
    "covered_points",
    "date_bounds",
    "drop_excluded",
    "first_cover",
    "first_per_key",
    "in_date_range",
    "interval_hits",
    "interval_left_join",
    "latest_per_key",
    "null_aware_anti",
    "open_total",
    "snapshot_dates",
    "spans_without_points",
    "spread_left_join",
    "version_spans",
    "versions_on",
]
