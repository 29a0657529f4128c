"""skein: turning structured documents into searchable rows, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to the workers with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
