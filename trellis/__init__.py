"""trellis: a Spark-native engine for comparing predictive models over tables.

Sources make or read tables, splits give reproducible roles, operators fit and
score models as grouped Spark jobs, and plans tie them into comparisons and the
registered queries.  See README.md for the map.
"""

__version__ = "0.1.0"
