"""Longitudinal object tracking and two-channel time-series analysis on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to the executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
