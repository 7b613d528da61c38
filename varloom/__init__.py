"""Cohort variant-call analytics as DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the query, which need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
