"""Structured Streaming over events and submissions."""
