"""Operators for large text corpora; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
