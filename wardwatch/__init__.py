"""Care-room sensor analytics as PySpark DataFrame operators and streaming jobs."""

from wardwatch.session import configure

__all__ = ["configure"]
