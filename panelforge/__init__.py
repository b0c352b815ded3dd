"""A PySpark-native factor-research engine."""
