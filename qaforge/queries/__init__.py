"""Driver queries, one module per family."""

from importlib import import_module

MODULES = ["text_queries", "label_queries", "rule_queries", "page_queries", "dedupe_queries", "nearest_queries", "table_queries", "prompt_queries", "source_queries", "sketch_queries"]


def load():
    """Import all families and return the module that holds the registry."""
    for name in MODULES:
        import_module(f"qaforge.queries.{name}")
    return import_module("qaforge.queries.base")
