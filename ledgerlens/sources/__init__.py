"""Sources and sinks: raw exports, the driver-table mapping, the prepared table."""

from ledgerlens.sources.bucketed import CardTable, save_by_card  # noqa: F401
from ledgerlens.sources.fixtures import raw_exports, raw_from_driver_tables  # noqa: F401
from ledgerlens.sources.raw import checked_raw, conform_raw, load_raw, read_raw, read_raw_checked  # noqa: F401
from ledgerlens.sources.sinks import read_transactions, write_transactions  # noqa: F401
