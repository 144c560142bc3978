"""featloom: feature generation, scoring and selection on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from featloom.dataset import Dataset, Feature

# Kernels that run inside Python workers are pickled by value, so a job needs no
# separate package installation on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Dataset", "Feature"]
