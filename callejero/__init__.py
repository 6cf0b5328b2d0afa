"""callejero: a PySpark-native engine for messy postal addresses."""
