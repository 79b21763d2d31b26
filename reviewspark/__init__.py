"""Review analytics on Spark: clean, assign themes, report, explore, summarise."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so a job runs from
# any folder and on executors that do not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
