"""A PySpark-native engine for retrieval, dialogue analytics and biosignal series."""
