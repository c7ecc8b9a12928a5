"""quern: a Spark-native analytics engine for text, label and embedding corpora."""
