"""A PySpark-native engine for document-layout, corpus and cohort analytics."""
