"""Readers: diffs, directories, package files, tools' output, replies of a model."""

import sys

from pyspark import cloudpickle

# Parsers go to the workers by value, so that a cluster need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules["revlens.sources"])
