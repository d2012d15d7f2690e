"""Imports every plan module so their ``@query`` registrations run."""

from __future__ import annotations

import importlib

PLAN_MODULES = ["core", "features", "reports", "alerting", "training", "neighbors", "models", "streams"]


def registry():
    for mod in PLAN_MODULES:
        importlib.import_module(f"{__package__}.{mod}")
    from .registry import REGISTRY
    return REGISTRY
