"""Spark-native analytics for networks of time-stamped sensors."""
