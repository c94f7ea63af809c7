"""Queries over the driver's tables, with their SQL twins."""

from . import geometry, layout, pipelines, sections, solvers, stack, tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
