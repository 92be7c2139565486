"""A Spark-native engine for auditable feature engineering and corpus preparation."""

__version__ = "0.1.0"
