"""Market and event time-series analytics as Spark DataFrame programs."""
