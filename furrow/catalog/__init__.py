"""Registered queries: each operator on the given tables, with its SQL check."""

from furrow.catalog import bands, images, sources, tasks, telemetry, vectors  # noqa: F401
from furrow.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
