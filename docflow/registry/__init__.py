"""Named queries over the standard tables, each with the SQL that states the expected rows."""

from importlib import import_module

MODULES = ("scalars", "structure", "crawl", "retrieval", "records", "vitals", "chat", "files", "streams", "care", "frontier")


def load():
    """Import every registry module; returns ``(queries, oracles)``."""
    from docflow.registry import base

    for name in MODULES:
        import_module(f"docflow.registry.{name}")
    return base.QUERIES, base.ORACLES
