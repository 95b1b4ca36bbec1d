"""Spark-native analytics over images, vector fields and point sets held as DataFrames."""
