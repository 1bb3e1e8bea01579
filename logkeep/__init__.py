"""Archive and replay partitioned message logs with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need only PySpark, NumPy and Arrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
