"""Spark-native analytics over daily price observations at geolocated points of sale."""
