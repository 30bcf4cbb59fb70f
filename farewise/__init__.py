"""Marketplace analytics on Spark DataFrames: trips, choices, prices, drivers, experiments."""

import sys

from pyspark import cloudpickle

# Ship the few Python task functions with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
