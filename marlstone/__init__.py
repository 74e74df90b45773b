"""marlstone: a Spark-native engine for curating web, media and robotics data."""

__version__ = "0.1.0"
