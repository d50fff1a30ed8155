"""Operators for building training corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
