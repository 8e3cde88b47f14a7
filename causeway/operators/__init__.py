"""Graph, evidence, routing, diagnosis and evaluation operators: DataFrames in, DataFrames out."""
