"""The function registry: importing this package fills base.REGISTRY."""

from . import arrays, conditional, dates, hashes, jsons, maths, search, strings
from .base import REGISTRY, X, call

__all__ = ["REGISTRY", "X", "arrays", "call", "conditional", "dates", "hashes", "jsons", "maths", "search", "strings"]
