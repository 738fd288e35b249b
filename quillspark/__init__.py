"""quillspark: document-collection analytics as PySpark DataFrame pipelines."""

import sys

from pyspark import cloudpickle

# Python workers get our functions by value, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
