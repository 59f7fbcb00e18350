"""A PySpark-native engine for hierarchical catalogues: search, change data, entity resolution, text functions."""
