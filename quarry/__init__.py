"""quarry: a PySpark-native code-knowledge and text analytics engine."""
