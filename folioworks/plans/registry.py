"""Collects the registered queries of the plan modules: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ("lexicon_plans", "metrics_plans", "page_plans", "dataset_plans", "run_plans")


def _entries() -> dict:
    found: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"folioworks.plans.{name}")
        for key, value in module.QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = value
    return found


def queries() -> dict:
    return {name: run for name, (run, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
