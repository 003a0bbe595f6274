"""Position-level string analytics as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that executors
# need no copy of it on their own paths.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
