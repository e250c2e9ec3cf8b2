"""Incremental re-scoring: batch discovery, micro-batch scoring, comparison with a baseline."""
