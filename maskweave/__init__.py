"""Masking, classification and leak auditing of tables and streams on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the workers with the job, so nothing is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
