"""Training-data operators (one module per operator) and their queries.

Nothing outside this subpackage imports it.  Worker functions travel by value,
so executors need the public libraries only, not this package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
