"""candor: a Spark-native query engine whose answers can be trusted."""
