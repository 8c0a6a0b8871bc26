"""Spark-native analytics for collections of measured curves."""

__version__ = "0.1.0"
