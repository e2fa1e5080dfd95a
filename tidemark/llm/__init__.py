"""Operators for preparing training corpora; nothing else in the library imports this subpackage.

Python workers get these modules by value, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
