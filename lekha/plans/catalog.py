"""Importing this module registers every query."""

from . import frame_queries, score_queries, set_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
