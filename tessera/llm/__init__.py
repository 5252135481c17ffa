"""Operators for preparing training text. Nothing outside this package imports it."""

from pyspark import cloudpickle

import tessera

# Executors may not have this package on their path, so its functions travel by value.
cloudpickle.register_pickle_by_value(tessera)
