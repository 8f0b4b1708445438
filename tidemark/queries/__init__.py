"""The registered queries, each with equivalent SQL where SQL can say it."""

from . import composite, duplicate, missing_values, model, outlier, profiling, scale, source, text
from .registry import QUERIES

__all__ = [
    "QUERIES", "composite", "duplicate", "missing_values", "model", "outlier", "profiling", "scale",
    "source", "text",
]
