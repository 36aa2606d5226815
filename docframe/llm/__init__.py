"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Worker functions are shipped by value, so
executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
