"""Evaluation of segmentations of an integer axis, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of the library travel to the executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
