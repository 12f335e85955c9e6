"""Pivot analytics over ordered bar streams, on Spark."""
