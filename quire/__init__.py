"""Document-corpus processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a job runs where
# the package is installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
