"""Queries over the given tables, one module per section of the operator list."""

from importlib import import_module

MODULES = ["scalars", "align", "fusion", "evaluate", "aggregates", "timeseries", "sequences", "sampling", "ingest", "folds", "streams"]


def load_all() -> None:
    for m in MODULES:
        import_module(f"strideline.plans.{m}")
