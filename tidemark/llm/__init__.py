"""Operators for large text corpora: search, near duplicates, extraction, archives, scoring, sharding, mixing, packing.

Nothing outside this folder imports it, except that the entry module adds its queries when it is there.
"""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their tasks, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
