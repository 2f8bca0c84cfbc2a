"""Operators for training-data preparation: filtering, deduplication, extraction and encoding."""
