"""Streaming wrappers of batch operators."""
