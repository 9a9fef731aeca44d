"""chronofold: Spark-native analytics for tagged metric time series."""
