"""tessera: a Spark-native engine for ranked retrieval over session logs."""
