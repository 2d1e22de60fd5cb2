"""Spark-native cleaning, labelling and de-duplication of link collections.

Everything is expressed on DataFrames partitioned by ``collection_id``:
column functions live in :mod:`linkwork.functions`, readers in
:mod:`linkwork.sources`, set-based operators in :mod:`linkwork.operators`,
text/HTML/JSON writers in :mod:`linkwork.sinks` and composite flows in
:mod:`linkwork.plans`.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so executors need not have it installed.

    The HTML parser and the document writer run in Python workers; with the package
    registered, Spark sends their code with the task instead of importing it on executors.
    """
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark always ships it
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
