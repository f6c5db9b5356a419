"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with their tasks, so that the
# executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
