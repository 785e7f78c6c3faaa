"""ferrule: a Spark-native analytics engine for corpora of executable code and text."""
