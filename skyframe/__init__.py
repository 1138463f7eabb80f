"""Weather and geospatial time-series analytics as Spark DataFrame operators."""
