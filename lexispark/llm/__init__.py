"""Operators for preparing large text corpora, and their registered queries.

The functions that run in Python tasks are pickled by value, so executors need no copy
of this package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
