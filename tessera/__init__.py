"""tessera: a PySpark-native record-linkage analytics engine."""
