"""Scalar helpers. All are Column expressions, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats the reference prints.
MESSAGE_FORMAT = "Getting unique %s to set selectInput choices: coming from %s"
SIZE_FORMAT = "Dataset has %s rows (%s on disk)"

# Binary size units, one letter each.
SIZE_UNITS = ["B", "K", "M", "G", "T", "P", "E"]


def label(prefix: str | Column, position: Column) -> Column:
    """Label such as ``A1``: a prefix followed by a position."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, position.cast("string"))


def letter(position: Column) -> Column:
    """Capital letter at a 1-based position; null outside 1..26."""
    return F.when(position.between(1, 26), F.char(F.lit(64) + position))


def join_lines(parts: Column) -> Column:
    """Join an array of strings with line breaks."""
    return F.concat_ws("\n", parts)


def thousands(number: Column) -> Column:
    """Whole number with a comma between groups of three digits."""
    return F.format_number(number, 0)


def is_true(condition: Column) -> Column:
    """A condition where unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def append_entry(entries: Column, entry: Column) -> Column:
    """Array with one more entry at its end."""
    return F.array_append(entries, entry)


def first_entry(entries: Column) -> Column:
    """First entry of an array, null if it is empty."""
    return F.try_element_at(entries, F.lit(1))


def update_message(level: Column, came_from: Column) -> Column:
    """Log line for the refresh of one level."""
    return F.format_string(MESSAGE_FORMAT, level, came_from)


def file_size_text(size: Column) -> Column:
    """Byte count in binary units with three significant digits, such as ``600M``."""
    text = F.lit(None).cast("string")
    for power, unit in enumerate(SIZE_UNITS):
        scaled = F.round(size / F.lit(float(1024**power)), 2)
        digits = F.when(scaled >= 100, F.round(scaled, 0)).when(scaled >= 10, F.round(scaled, 1)).otherwise(scaled)
        # two decimal places are always present, so only zeros after the point are cut
        shown = F.regexp_replace(digits.cast("decimal(20,2)").cast("string"), r"\.?0+$", "")
        in_unit = F.concat(shown, F.lit(unit))
        text = in_unit if power == 0 else F.when(size >= F.lit(1024**power), in_unit).otherwise(text)
    return text


def size_line(n_rows: Column, size: Column) -> Column:
    """Summary line with the row count and the size on disk."""
    return F.format_string(SIZE_FORMAT, thousands(n_rows), file_size_text(size))
