"""Streaming of the record-linkage engine."""
