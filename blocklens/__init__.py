"""Search, field extraction, verification and review over tables of positioned text blocks."""

import sys

from pyspark import cloudpickle

# The helpers inside Arrow batches travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
