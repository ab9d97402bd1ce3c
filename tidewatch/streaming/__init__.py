"""Streaming of the detection engine."""
