"""Readers, writers, validation, merging and migration of graph, task and result files."""
