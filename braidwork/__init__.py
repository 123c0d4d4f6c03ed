"""Composable DataFrame, Column and streaming functions for Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they don't need it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
