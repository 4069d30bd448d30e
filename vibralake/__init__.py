"""Prescriptive maintenance analytics on Spark DataFrames."""

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel with their code, so workers need no installed copy.
cloudpickle.register_pickle_by_value(__import__(__name__))
