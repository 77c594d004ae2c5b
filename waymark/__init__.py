"""waymark: a Spark-native engine for lead discovery, entity resolution and scoring."""
