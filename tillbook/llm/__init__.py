"""Training-data operators: packing, quality, dedup, scans, tokens.

Nothing else in the library imports this package.  Each module holds one
operator with a general interface; ``queries`` registers the thin queries
over the driver tables.

Task functions are shipped by value, so executors need the third-party
libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
