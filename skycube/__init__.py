"""Spark jobs for radio-sky image cubes."""
