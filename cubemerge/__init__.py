"""cubemerge: schema-driven scientific datasets as Spark DataFrames.

Cells are kept in long form (one row per coordinate tuple); every operator takes and returns DataFrames
or Columns, and stays lazy unless its docstring says otherwise.
"""

import sys

from pyspark import cloudpickle

from cubemerge.schema import Coord, DateTimeUnit, NodeSchema, Variable
from cubemerge.session import get_session

__all__ = ["Coord", "DateTimeUnit", "NodeSchema", "Variable", "get_session"]

# pandas functions travel to the executors with their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
