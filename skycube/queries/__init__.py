"""Registered queries: each operator on the driver's tables, beside the same thing in SQL."""

from . import cube, further, ingest, inventory, quality, streams, tracks, workloads
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cube", "further", "ingest", "inventory", "quality", "streams", "tracks", "workloads"]
