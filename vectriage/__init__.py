"""vectriage: similarity search and ticket/review triage analytics on Spark.

Every operator takes and returns Spark DataFrames.  The heavy work
(vector distance, top-k, grouping, joins) runs in Spark tasks; Python
code inside tasks is limited to Arrow-batched NumPy kernels.
"""

__version__ = "0.1.0"


def _pickle_by_value() -> None:
    """Ship this package's code inside the pickled task functions.

    Arrow kernels and UDFs defined here are normally pickled by reference
    (module name only), which needs the package installed on every
    executor.  Registering the package for pickling by value makes the
    tasks self-contained, the same on a cluster as in local mode.
    """
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_pickle_by_value()
