"""Operators for training-data pipelines over tables of documents and web pages.

The modules travel with their tasks (pickled by value), so workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
