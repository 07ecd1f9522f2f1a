"""The queries by name."""

from tracewell.plans import administration, catalogue, feeds, governance, lineage, tracing  # noqa: F401  (each registers its queries)
