"""Operators for preparing language-model training data; nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Tasks get this folder's functions by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
