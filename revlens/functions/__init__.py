"""Scalar functions as Column expressions."""

import sys

from pyspark import cloudpickle

# Functions go to the workers by value, so that a cluster need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules["revlens.functions"])
