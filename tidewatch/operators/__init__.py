"""Operators of the detection engine."""
