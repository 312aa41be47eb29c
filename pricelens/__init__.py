"""Product text to price, on Spark: curation, enrichment, models, retrieval, evaluation and deals."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
