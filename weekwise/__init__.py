"""weekwise: exposure-outcome analytics on weekly panels, expressed as Spark DataFrame operators.

A *panel* is a DataFrame with one row per ``(entity, week_start)``; ``week_start`` is a Monday DATE.
Every operator takes DataFrames and column names and returns a lazy DataFrame. Operators that must
run a small job while the plan is built say so in their docstring.
"""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
