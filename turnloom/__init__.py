"""turnloom: conversation-context analytics as Spark jobs.

Tables of conversation turns go in, DataFrames come out.  Every operator is
``DataFrame -> DataFrame`` or ``Column -> Column``.
"""

import sys

from pyspark import cloudpickle

from turnloom.config import Settings
from turnloom.session import build_session, checkpointed

# executors need no installed copy of this package: functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings", "build_session", "checkpointed"]
