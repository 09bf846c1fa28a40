"""Whole workloads composed of operators."""
