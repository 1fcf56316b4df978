"""Operators of a training-data pipeline: language ID, quality, near duplicates, tokens, mixing.

Nothing else in the library imports this subpackage. Functions that run inside Spark's
Python workers are pickled by value, so executors need no copy of the package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
