"""All registered queries."""

from weftlink.registry import citing, figures, library, linkage, storage, texts, topics  # noqa: F401
from weftlink.registry.base import QUERIES

__all__ = ["QUERIES"]
