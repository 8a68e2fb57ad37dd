"""DataFrame-level building blocks shared by the reports."""

from ledgerlens.operators.alerts import (  # noqa: F401
    absolute_rules, context_risk, hourly_profile, layered_alerts, personal_baseline,
)
from ledgerlens.operators.joins import interval_join, nearest_preceding_pairs  # noqa: F401
from ledgerlens.operators.percentiles import percentile_by  # noqa: F401
from ledgerlens.operators.ranking import global_ntile, global_rank  # noqa: F401
from ledgerlens.operators.rates import expected_vs_actual, label_rate, rank_by, top_k  # noqa: F401
from ledgerlens.operators.rfm import rfm_base, rfm_score, segment_exposure, share_of_total, with_segments  # noqa: F401
from ledgerlens.operators.rollup import add_months, merged_rate, rate_states, read_states, write_states  # noqa: F401
from ledgerlens.operators.series import (  # noqa: F401
    cohort_matrix, consistency, period_delta, previous_value, rolling_mean, rolling_trend, trend_label,
)
