"""All queries: importing the modules registers them."""

from __future__ import annotations

from . import graph_queries, learner_queries, model_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
