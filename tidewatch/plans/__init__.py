"""Plans of the detection engine."""
