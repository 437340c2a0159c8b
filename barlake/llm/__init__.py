"""Operators for text corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# What runs in tasks travels to the workers as code, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
