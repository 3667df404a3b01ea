"""Operators for preparing training text: token files, near-duplicates, classifiers, archives."""

import sys

from pyspark import cloudpickle

# tasks carry this code with them, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
