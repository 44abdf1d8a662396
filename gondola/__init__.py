"""Sales and stock analytics over a star schema, as PySpark DataFrame operators."""

from gondola.sources.schema import StarSchema

__all__ = ["StarSchema"]
