"""Structured Streaming: the exactly-once indexer, the session predictor, the producer."""
