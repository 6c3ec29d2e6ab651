"""Event-marketplace analytics expressed as Spark DataFrame operators."""

from boxoffice.sources.tables import Tables

__all__ = ["Tables"]
