"""sluice: a PySpark-native data engine for model post-training pipelines."""
