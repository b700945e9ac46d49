"""Registered queries of this subpackage; importing it fills ``LLM``."""

from clauseweave.plans.registry import Registry

LLM = Registry()

from clauseweave.llm import query_language, query_pages, query_records, query_texts  # noqa: E402, F401
