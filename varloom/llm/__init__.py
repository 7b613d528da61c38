"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the query, which need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
