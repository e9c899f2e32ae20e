import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import stepwell as sw  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = sw.local_session("tests", 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def grid(spark):
    """The sample table with one copy of each combination, and its row numbers."""
    table = sw.combination_grid(spark, sw.sample.DOMAINS, position="place")
    return sw.exclude_pairs(table, sw.sample.RULES).cache()


@pytest.fixture(scope="session")
def grid_index(grid):
    return sw.build_index(grid, sw.sample.LEVELS)
