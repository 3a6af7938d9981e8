"""Analytics over raster-chip catalogues, pixels and segmentation results as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# code travels with the tasks, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
