"""A PySpark-native engine for exploratory data analysis."""
