"""Training-data operators: near-duplicate search, cleaning, packing, mixing,
toxicity scoring, sharding and WARC archives, each written for Spark.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with the job, so that a cluster needs
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
