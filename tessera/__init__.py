"""A PySpark-native analytics engine for the data side of language-model post-training."""
