"""Loan-book and transaction screening on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that Spark sends to Python workers travel with their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
