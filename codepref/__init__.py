"""codepref: Spark-native building and evaluation of preference-tuning
datasets for code models.

Python callables that run inside Spark tasks (the pandas UDFs of the parse
check, the AST normaliser, the predictor) are shipped by value, so executors
need no installed copy of this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
