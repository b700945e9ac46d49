"""Registered queries of the core; importing this package fills ``CORE``."""

from clauseweave.plans.registry import CORE
from clauseweave.queries import analyses, evals, exchange, graphs, hierarchy, language, patterns, relational, segments, sources, texts  # noqa: F401

__all__ = ["CORE"]
