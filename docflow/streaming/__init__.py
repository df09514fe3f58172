"""Structured Streaming jobs that share column logic with the batch operators."""
