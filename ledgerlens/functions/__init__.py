"""Column-level expressions (all JVM built-ins; no Python UDFs)."""

from ledgerlens.functions.bands import (  # noqa: F401
    age_band, amount_band, band, city_size_band, confidence_label, distance_band, risk_condition, risk_flag,
)
from ledgerlens.functions.calendar import (  # noqa: F401
    age_at, epoch_second, month_index, month_start, months_between_starts, seconds_between,
)
from ledgerlens.functions.geo import great_circle_km  # noqa: F401
from ledgerlens.functions.numeric import (  # noqa: F401
    cond_sum, dec, flag_sum, money, pct, pct_exact, ratio, safe_div,
)
from ledgerlens.functions.rfm import rfm_action, rfm_segment, rfm_sub_segment  # noqa: F401
