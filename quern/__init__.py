"""quern: a PySpark-native analytics engine."""
