"""Table sources."""

from veilmark.sources.tables import table

__all__ = ["table"]
