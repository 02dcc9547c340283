"""hearthgrid: building-level population features and models as plain Spark jobs."""

from hearthgrid.layer import Layer

__all__ = ["Layer"]
