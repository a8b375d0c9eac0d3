"""Structured Streaming forms of the incremental fit and of pool scoring."""
