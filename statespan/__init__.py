"""Exact analytics over large implicit state graphs, built on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so executors need no copy of
# this package on their own module path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__: list[str] = []
