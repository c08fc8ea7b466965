"""driftwise: Spark-native feature building, drift and decay monitoring for per-entity time series.

Every operator is a DataFrame -> DataFrame function built from native Spark expressions.
"""

__version__ = "0.1.0"
