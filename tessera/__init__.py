"""A Spark-native retrieval and answer-grounding library."""
