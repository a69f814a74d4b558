"""All queries of the library's operators and their SQL."""

from __future__ import annotations

from . import access, evaluation, facts, graphs, ranking, sources, streams, texts  # noqa: F401  (each registers its own)
from .registry import ORACLES, QUERIES, TABLES  # noqa: F401
