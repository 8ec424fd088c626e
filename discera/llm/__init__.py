"""Operators for preparing training text: ten row-complete, skew-proof steps over document tables.

Nothing else in the library imports this subpackage. Its functions are shipped to
executors by value, so workers need numpy and pyarrow but no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
