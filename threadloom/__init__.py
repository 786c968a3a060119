"""Spark-native engine for agent-session transcripts, and operators for training-data pipelines."""
