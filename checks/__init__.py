"""Registered queries with the ANSI SQL that has to give the same rows."""

from importlib import import_module

_GROUPS = ("views", "documents", "jobs", "basics", "streams")


def load():
    """The registry with every group of queries loaded."""
    for group in _GROUPS:
        import_module(f"checks.{group}")
    return import_module("checks.registry")
