"""Registered queries, one module per area."""

from importlib import import_module

AREAS = ("behaviour", "ranking", "cleaning", "social", "models", "restaurants", "study")


def load() -> None:
    """Import every area so that its queries are registered."""
    for area in AREAS:
        import_module(f"footfall.catalog.{area}")
