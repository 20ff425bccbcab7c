"""Registered queries: each pairs an operator on the driver tables with the SQL that must agree with it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("indicators", "price_action", "market", "series", "crosssection", "evaluation", "portfolio", "options", "fundamentals", "aggregates", "alignment", "textual", "derived", "streaming")


def load_plans():
    from barloom.plans.registry import PLANS

    for name in MODULES:
        import_module(f"barloom.plans.{name}")
    return PLANS
