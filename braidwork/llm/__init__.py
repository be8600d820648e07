"""Training-data operators. Nothing else in the library imports this subpackage.

Functions shipped to Python workers are pickled by value, so workers need no copy of the package on
their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
