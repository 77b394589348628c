"""A PySpark-native engine for evenly sampled time series and the events found in them."""
