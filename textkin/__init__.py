"""textkin: Spark-native catalog cleaning, similarity search, duplicate detection and clustering."""
