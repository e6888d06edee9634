"""Market time-series analytics on Spark."""
