"""Training-data operators: text in, documents, spans, pairs, tokens or scores out.

Nothing outside this package imports it.  Functions of the package that run on
executors are pickled by value, so a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
