"""A Spark-native engine for evidence-first checking of collections of files, documents and pages."""
