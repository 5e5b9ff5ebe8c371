"""tessella: a PySpark-native analytics engine for media catalogs."""
