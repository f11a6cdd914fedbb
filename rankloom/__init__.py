"""Profile matching, ranking and chat-log analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions and classes of this package travel to the executors by value, so that the package itself
# need not be installed there. Broadcast values hold plain arrays and lists only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
