"""slotwise: a PySpark-native secondary-index and corpus-processing engine."""
