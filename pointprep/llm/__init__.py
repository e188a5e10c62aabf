"""Operators for large training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Worker functions travel by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules["pointprep"])
