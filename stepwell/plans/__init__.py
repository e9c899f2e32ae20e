from stepwell.plans.index import LevelIndex, as_index, build_index, read_index, refresh_index, update_index, write_index
from stepwell.plans.positions import dense_positions, positions_in_group

__all__ = [
    "LevelIndex",
    "as_index",
    "build_index",
    "dense_positions",
    "positions_in_group",
    "read_index",
    "refresh_index",
    "update_index",
    "write_index",
]
