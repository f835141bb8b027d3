"""A Spark-native catalog and query engine for packaged binary assets."""
