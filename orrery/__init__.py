"""Geometric analytics for vector point clouds, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the jobs that use them, so the executors
# need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
