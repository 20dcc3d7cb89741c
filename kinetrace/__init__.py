"""PySpark-native engine for multi-rate sensor data and point clouds."""

__version__ = "0.1.0"
