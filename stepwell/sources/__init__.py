from stepwell.sources.generate import (
    allowed_grid,
    combination_grid,
    label_domain,
    labels_up_to,
    replicate_rows,
    stack_tables,
)
from stepwell.sources.tables import scan, storage_size, write_table

__all__ = [
    "allowed_grid",
    "combination_grid",
    "label_domain",
    "labels_up_to",
    "replicate_rows",
    "scan",
    "stack_tables",
    "storage_size",
    "write_table",
]
