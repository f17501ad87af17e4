"""Operational analytics and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# functions for Python workers travel by value, so that workers need not have this
# package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
