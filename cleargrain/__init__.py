"""Spark-native data quality, repair and anomaly labelling for dirty sales tables."""
