"""Operators over corpora of texts, pages and vectors, and the registered queries of them."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
