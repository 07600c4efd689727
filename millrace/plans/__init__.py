"""Queries over the driver's tables; ``catalog`` has them all by name."""

from millrace.plans import catalog, connections, files, fitted, forest, places, screening, summaries  # noqa: F401
