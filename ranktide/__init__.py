"""ranktide: recommendation analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: a worker needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
