"""A Spark-native engine for finite-element results, kept as ordinary DataFrames."""
