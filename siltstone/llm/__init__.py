"""Training-data operators; nothing outside this folder imports it but the entry file's guard.

The functions that run in tasks travel with them, so that executors need no copy of the package.
"""

from pyspark import cloudpickle

import siltstone

cloudpickle.register_pickle_by_value(siltstone)
