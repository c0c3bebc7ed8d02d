"""Query plans of the core; registries() gives them all."""

from __future__ import annotations

import importlib


def registries() -> list:
    return [importlib.import_module(f"inkwell.plans.{m}").R for m in ("corpus_queries", "mask_queries", "style_queries", "relational_queries", "source_queries", "catalogue_queries", "report_queries")]
