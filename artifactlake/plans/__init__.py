"""Registered queries: each binds an operator to the supplied tables and carries its check SQL."""

from importlib import import_module

MODULES = (
    "filters",
    "paging",
    "aggs",
    "joins",
    "updates",
    "windows",
    "classify",
    "flagship",
    "content",
    "records",
    "dedupe",
    "graphs",
    "locators",
    "nested",
    "exports",
    "streams",
)


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
