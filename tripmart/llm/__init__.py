"""Operators for preparing training data: language, duplicates, leaks, licences, mixing, archives, scoring."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
