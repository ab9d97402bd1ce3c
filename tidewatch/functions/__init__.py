"""Functions of the detection engine."""
