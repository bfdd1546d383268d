"""The registered queries and their SQL counterparts."""

import importlib

MODULES = ("harmonizing", "gridding", "aligning", "viewing", "extracting", "storing", "sourcing")


def load_queries() -> None:
    """Import the query modules, which register themselves."""
    for module in MODULES:
        importlib.import_module(f"cubemerge.plans.{module}")
