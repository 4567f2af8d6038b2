"""Corpus preparation for language-model training: dedup, filters, tokenizers, mixing and formatting.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions travel to the executors whole: these need not have the library installed, nor share the driver's folder.
register_pickle_by_value(sys.modules[__name__])
