"""quarry: Spark-native text-to-table extraction and forgiving table queries.

Everything here builds lazy DataFrames; nothing pulls a table through the
driver. See README.md for the operator map.
"""

__version__ = "0.1.0"


def __getattr__(name):
    if name == "Tables":
        from quarry.operators.tables import Tables
        return Tables
    raise AttributeError(name)
