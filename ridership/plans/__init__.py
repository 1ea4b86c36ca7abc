"""Flows composed from the operators: feature store, training input, prediction input."""
