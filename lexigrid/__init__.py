"""lexigrid: a Spark-native engine for text-corpus retrieval, answer auditing and evaluation."""
