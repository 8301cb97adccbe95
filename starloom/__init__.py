"""Search, ranking and data preparation as PySpark plans. The public names are imported on first use."""

from importlib import import_module

_HOMES = {
    "Engine": "starloom.plans.engine", "NotFound": "starloom.plans.engine", "SearchRequest": "starloom.plans.query", "parse_request": "starloom.plans.query",
    "Filters": "starloom.operators.filters", "SearchIndex": "starloom.operators.index", "fuse": "starloom.operators.fusion", "lab_search": "starloom.plans.lab", "build_index": "starloom.sources.sinks",
}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"module 'starloom' has no attribute {name!r}")
    return getattr(import_module(_HOMES[name]), name)
