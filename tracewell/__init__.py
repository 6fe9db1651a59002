"""Audit-stream and corpus analytics built on Spark DataFrames."""
