"""Stored indexes: segments, manifests, compaction, collection, and the coordinator that queries them."""
