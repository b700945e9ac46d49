"""Plan helpers: session defaults, table access, lineage cuts, the query registry."""
