"""Operators for preparing training text: ten stand-alone operators over documents and pages.

Functions that run in Python workers travel with the job, so executors need not
have this package installed.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
