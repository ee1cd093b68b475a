"""Spark jobs for map features at scale, and (in ``llm``) for training text.

Functions that run inside Spark's Python workers are shipped by value, so a
cluster's workers need pyspark, pyarrow, pandas and numpy, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
