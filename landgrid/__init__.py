"""Land and territory analytics as DataFrame-in, DataFrame-out Spark operators."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the plan, so executors
# do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
