"""tallyframe: evaluate and compare multi-task classifiers over large prediction tables on Spark.

Every operator takes DataFrames and returns a DataFrame.  Metrics are computed
from confusion counts ("cells"), so the fact table is read once however many
metrics are asked for.
"""

from tallyframe import functions, operators, plans, sources

__all__ = ["functions", "operators", "plans", "sources"]
