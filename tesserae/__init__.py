"""A PySpark-native engine for the records of visual-inspection pipelines."""
