"""pointprep: Spark-native preparation and evaluation of short-text label data."""
