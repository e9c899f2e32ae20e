from stepwell.operators.cascade import (
    cascade_trace,
    check_selection,
    default_selection,
    keep_or_first,
    resolve_selection,
    trace_messages,
    trace_text,
)
from stepwell.operators.choices import choices, choices_for, preview, root_choices, row_count
from stepwell.operators.filters import drill_down, exclude_pair_table, exclude_pairs, is_member, where_equals
from stepwell.operators.quality import PairRule, absent_pairs, absent_ranges, check_rules, structure, summary

__all__ = [
    "PairRule",
    "absent_pairs",
    "absent_ranges",
    "cascade_trace",
    "check_rules",
    "check_selection",
    "choices",
    "choices_for",
    "default_selection",
    "drill_down",
    "exclude_pair_table",
    "exclude_pairs",
    "is_member",
    "keep_or_first",
    "preview",
    "resolve_selection",
    "root_choices",
    "row_count",
    "structure",
    "summary",
    "trace_messages",
    "trace_text",
    "where_equals",
]
