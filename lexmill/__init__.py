"""Lexical-retrieval analytics on Spark: text functions, Boolean phrase search, query building, ranking, evaluation and analysis as DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so that executors needn't have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
