"""Registered queries: every operator applied to the driver tables, with equivalent SQL."""

from __future__ import annotations

import importlib

MODULES = ("charts", "profiling", "quality", "rca", "sources", "operations", "analytics", "runs")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"casemill.workload.{name}")
