"""Operators for large text corpora; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions of all its modules travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
