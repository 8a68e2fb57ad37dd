"""Incremental (Structured Streaming) form of the hourly layer-1 alert rules."""

from ledgerlens.streaming.hourly import (  # noqa: F401
    hourly_alert_stream, hourly_profile_stream, read_raw_stream, start_hourly_alerts,
)
