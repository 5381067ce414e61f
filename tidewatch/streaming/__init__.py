"""Analyses of endless inputs, by Structured Streaming."""
