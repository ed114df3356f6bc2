"""Spark-native analytics for evaluation records: every operator takes and returns DataFrames."""
