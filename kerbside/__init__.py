"""Spark-native analytics for camera-derived traffic data."""
