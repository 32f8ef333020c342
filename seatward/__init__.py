"""Quota, waitlist and territory analytics on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions run by Python workers travel whole, so the workers need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
