"""A PySpark-native engine for corpora of documents, posts and the events annotated on them.

Its functions are shipped to executors by value, so workers need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
