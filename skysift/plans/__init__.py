"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ("detection", "localization", "rasters", "floods", "clouds", "triage", "transfers")


def load() -> None:
    for name in MODULES:
        import_module(f"skysift.plans.{name}")
