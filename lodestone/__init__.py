"""Lodestone: permission-aware corpora, retrieval and training-data jobs on Spark DataFrames.

Functions that run inside Python workers are pickled by value, so executors need not have this
package installed or on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
