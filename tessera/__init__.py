"""A Spark-native engine for managing and querying large scientific file collections."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
