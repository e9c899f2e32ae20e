"""Drill-down over large tables along ordered category columns, on Spark DataFrames."""

from stepwell import sample  # noqa: F401
from stepwell.functions import *  # noqa: F401,F403
from stepwell.operators import *  # noqa: F401,F403
from stepwell.plans import *  # noqa: F401,F403
from stepwell.session import local_session, scratch, shared_dir, sweep  # noqa: F401
from stepwell.sources import *  # noqa: F401,F403
from stepwell.streaming import *  # noqa: F401,F403
