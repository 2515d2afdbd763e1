"""tsloom: a PySpark engine for preparing and evaluating time-series samples."""

import sys

from pyspark import cloudpickle

# Functions that run inside Spark tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
