from stepwell.functions.scalars import (
    append_entry,
    file_size_text,
    first_entry,
    is_true,
    join_lines,
    label,
    letter,
    size_line,
    thousands,
    update_message,
)

__all__ = [
    "append_entry",
    "file_size_text",
    "first_entry",
    "is_true",
    "join_lines",
    "label",
    "letter",
    "size_line",
    "thousands",
    "update_message",
]
