"""PySpark-native analytics over entity / season / event tables."""
