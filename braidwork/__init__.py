"""Functions and classes of this package that go to Python workers are pickled by value, so workers need no copy of it on their import path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
