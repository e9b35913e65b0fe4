"""All named queries of the core with the SQL that states the same."""

from __future__ import annotations

from corpusmill.plans import corpus, extra, files, logs, ordered, relational, streams  # noqa: F401
from corpusmill.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
