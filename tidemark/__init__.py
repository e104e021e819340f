"""Spark-native analysis of how news sentiment relates to stock returns."""
