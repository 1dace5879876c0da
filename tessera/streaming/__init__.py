"""Structured Streaming drivers of the batch operators."""
