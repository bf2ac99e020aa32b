"""All named queries and their SQL."""

from . import grounding, layout, planning, retrieval, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
