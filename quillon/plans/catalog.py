"""All query families of the engine, in one registry."""

from __future__ import annotations

import importlib

from .registry import Registry

FAMILIES = ("reports", "aggregates", "predicates", "lookups", "windows", "scalars", "metering", "graphs", "texts", "formats", "conversions")


def load() -> Registry:
    whole = Registry()
    for name in FAMILIES:
        whole.update(importlib.import_module(f"quillon.plans.{name}").registry)
    return whole
