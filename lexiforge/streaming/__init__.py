"""Structured Streaming runs of the stateless operators and the statistics aggregate."""
