"""Column helpers shared by the reports. All are built-in expressions; there are no UDFs."""

from loadlens.functions.rounding import half_up, per_exec
from loadlens.functions.text import (
    count_set_flags,
    grouped_text,
    indent,
    like,
    number_text,
    range_text,
    text_cat,
)
from loadlens.functions.times import (
    day_of,
    look_back,
    seconds_of,
    to_seconds,
    ts_lit,
    whole_second,
)

__all__ = [
    "count_set_flags",
    "day_of",
    "grouped_text",
    "half_up",
    "indent",
    "like",
    "look_back",
    "number_text",
    "per_exec",
    "range_text",
    "seconds_of",
    "text_cat",
    "to_seconds",
    "ts_lit",
    "whole_second",
]
