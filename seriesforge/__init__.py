"""Spark-native analytics for observation catalogs and irregular series."""
