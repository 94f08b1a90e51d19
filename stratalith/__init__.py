"""stratalith: a PySpark-native analytics engine (ordered frames, statistics, time series, text, linear algebra)."""
