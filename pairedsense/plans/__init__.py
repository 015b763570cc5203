"""Registered queries over the given tables, one module per family."""

from . import files, inference, modelling, results, scalars, series, signals, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
