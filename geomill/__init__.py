"""geomill: a Spark-first engine for point-of-interest integration and training-data work."""
