"""Every operator as a named query over the shared tables."""

from importlib import import_module

MODULES = ["sources", "filters", "joins", "aggregates", "windows", "sets", "scalars", "forecasts", "scores", "calibrations", "checks"]


def load() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
