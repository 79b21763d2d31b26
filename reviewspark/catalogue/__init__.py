"""Named queries over the test tables, each with its SQL counterpart."""

import importlib

from reviewspark.catalogue.registry import ORACLE, QUERIES

for _part in ("exploration", "cleaning", "theming", "conversion", "sampling", "resuming", "wording", "clustering",
              "summarising", "arriving", "density"):
    importlib.import_module(f"reviewspark.catalogue.{_part}")

__all__ = ["ORACLE", "QUERIES"]
