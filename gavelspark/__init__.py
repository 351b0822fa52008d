"""Auction and bidding analytics as PySpark operators over tables and streams."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
