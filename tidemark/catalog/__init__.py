"""Named queries over the sample tables, grouped by theme."""

import importlib

THEMES = ["activity", "features", "recommend", "ops", "tables", "storage", "contextual", "streams"]


def load_all():
    for theme in THEMES:
        importlib.import_module(f"tidemark.catalog.{theme}")
    from tidemark.catalog import registry

    return registry.QUERIES, registry.ORACLES
