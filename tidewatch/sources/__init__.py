"""Sources of the detection engine."""
