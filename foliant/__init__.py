"""foliant: persona-driven document intelligence as DataFrame plans on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with their task, so executors
# need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
