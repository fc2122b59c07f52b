"""florilege: Spark-native search, curation and analytics over large document collections."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have the package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
