"""Table analytics and machine learning as Spark jobs: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Tasks get the package's small numpy helpers with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
