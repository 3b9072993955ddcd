"""Sensor series, posterior fusion, sequence decoding and grouped evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel by value, so that workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
