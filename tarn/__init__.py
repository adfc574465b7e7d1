"""Spark-native analytics for gridded terrain and the water that runs over it."""
