"""vecscore: a Spark-native vector-scoring and corpus-processing engine."""

__version__ = "0.1.0"
