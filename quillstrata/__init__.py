"""Spark-native preparation of instruction/response text tables.

Every public function takes and returns a ``DataFrame`` or a ``Column``; nothing here holds a session.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Arrow functions travel with their code, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
