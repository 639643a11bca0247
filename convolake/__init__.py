"""Spark-native analytics for conversations, knowledge documents, usage ledgers and access control."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
