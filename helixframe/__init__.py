"""helixframe: Spark-native data work around sequence embeddings.

Every operator is a function ``DataFrame -> DataFrame`` (or a small
composition of them) expressed with the DataFrame API so Catalyst and AQE
plan the physical work.  Sub-packages:

* ``sources``    scans, sinks and the fixture tables derived from the inputs
* ``functions``  column expressions (hash uniforms, vector math)
* ``operators``  relational operators (shaping, encoding, pairs, scores ...)
* ``plans``      named query plans wired to the input tables
* ``streaming``  Structured Streaming twins of the batch operators
"""

from helixframe.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

# Ship the package's functions to Python workers by value, so executors need
# no installed copy of this package (cloudpickle resolves sub-modules too).
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
