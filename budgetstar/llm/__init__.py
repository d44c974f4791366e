"""Operators of a training-data pipeline: placement, scans, deduplication, token output, packing."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this subpackage with their closure, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
