"""Spark-native preparation, validation and explanation of gridded-point regression models.

Every public operator takes DataFrames and column names and returns a DataFrame.
Import operators from the sub-packages:

* ``terrafold.sources``   tables, landed climate responses, gridded cells
* ``terrafold.functions`` column selection and scalar expressions
* ``terrafold.operators`` preparation, sampling, binning, folds, metrics, models, explanations
* ``terrafold.plans``     the operators chained into the usual end-to-end jobs
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their code, so the workers
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
