"""Fleet-scale diagnostics of instrument time series, written for PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry this package's code, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
