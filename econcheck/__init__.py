"""Econcheck: checking statistical claims at scale with PySpark.

Every public operator is a function ``f(df, ...) -> DataFrame`` or a function
that builds a ``Column``; see the package README for the layout.
"""

__version__ = "0.1.0"
