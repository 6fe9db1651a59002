"""Keyed state: folds that run in Structured Streaming and in batch."""
