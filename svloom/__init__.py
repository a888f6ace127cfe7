"""Spark-native analytics over hardware-description source code and ordinary tables."""
