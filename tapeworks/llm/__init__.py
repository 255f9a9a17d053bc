"""Operators that prepare training data: sharding, dedup, scoring, mixing, filtering, decontamination and search."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so these need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
