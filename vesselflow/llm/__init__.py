"""Operators for cleaning text corpora that serve as training data.

The functions of this package that run on executors travel by value, so a cluster needs
no installed copy of it there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
