"""Operators for preparing training corpora at scale.

Nothing outside this subpackage imports it.  Queries over the synthetic tables
and their SQL are in :mod:`tessera.llm.queries`.
"""

import sys

from pyspark import cloudpickle

# executors get the functions that they run by value, so they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
