"""Training-data operators: deduplication, search, extraction, scoring, mixing and packing.

The helper functions that run inside Spark tasks are pickled by value, so executors need no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
