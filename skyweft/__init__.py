"""Spark-native image coaddition and analysis."""
