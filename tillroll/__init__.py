"""tillroll: Spark-native sales analytics.

sources    parquet tables, the line-level fact, pre-aggregated order/part sources, exports
functions  column expressions, distributed ranks and exact quantiles
operators  roll-ups, features, customers (RFM), baskets, inventory, forecasts, models
streaming  Structured Streaming daily aggregate
plans      the named query catalog and its DuckDB twins
"""

__version__ = "0.1.0"
