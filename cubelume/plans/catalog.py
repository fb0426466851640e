"""Every query by name, with its SQL twin."""

from __future__ import annotations

from . import board_queries, colour_queries, cube_queries, misc_queries, palette_queries, score_queries, stream_queries, summary_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
