"""Joint analysis of feature-by-sample layers on Spark.

Every operator takes and returns DataFrames.  Layers live in one long table
``layer, feature, sample, value`` (see :mod:`lamella.core`).
"""
import sys

from pyspark import cloudpickle

# pandas UDF bodies travel to the executors by value, so a cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

import numpy  # noqa: E402,F401  (loads the BLAS first)

from lamella.functions.blas import single_thread  # noqa: E402

single_thread()
