"""A PySpark-native analytics toolkit: frames, statistics, time series, matrices."""
