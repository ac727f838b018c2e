"""Where telemetry tables come from: stored parquet, or views over the given tables."""

from loadlens.sources.fixtures import Telemetry
from loadlens.sources.given import GIVEN, given_path, read_given
from loadlens.sources.schemas import BY_DATABASE, FACTS, OPEN, SCHEMAS
from loadlens.sources.store import (
    prune_days,
    read_open,
    read_report,
    read_telemetry,
    with_snap_day,
    write_report,
    write_telemetry,
)

__all__ = [
    "BY_DATABASE",
    "FACTS",
    "GIVEN",
    "OPEN",
    "SCHEMAS",
    "Telemetry",
    "given_path",
    "prune_days",
    "read_given",
    "read_open",
    "read_report",
    "read_telemetry",
    "with_snap_day",
    "write_report",
    "write_telemetry",
]
