"""Connected components of an edge table; the library's own."""

from sightline.operators.graph import components

__all__ = ["components"]
