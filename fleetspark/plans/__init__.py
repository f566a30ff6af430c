"""Registered queries: each is a callable over (spark, folder) with its SQL twin."""

from . import answers, fleet, questions, stores, texts
from .registry import Registry


def all_queries() -> Registry:
    """The registry with every query."""
    registry = Registry()
    for area in (fleet, questions, texts, answers, stores):
        area.register(registry)
    return registry
