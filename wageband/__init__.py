"""Wage-band engine: job postings to a labelled, balanced training table on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
