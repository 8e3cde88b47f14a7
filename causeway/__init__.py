"""Causeway: a Spark-native engine for causal-graph evidence queries and training-data preparation."""
