"""tuplemill: a PySpark-native engine for loosely structured tuple data."""
