"""Spark-native analytics for grain-storage sensor readings."""
