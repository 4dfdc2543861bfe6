"""corpusloom: a PySpark-native engine for building, maintaining and querying a text corpus."""
