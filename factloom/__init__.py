"""A graph and corpus analytics engine on Spark."""

import os as _os
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_root = _os.path.dirname(_os.path.dirname(_os.path.abspath(__file__)))
# Where workers can't import this package, functions go to them whole instead of by name.
if _root not in _os.environ.get("PYTHONPATH", "").split(_os.pathsep) and _os.getcwd() != _root:
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
