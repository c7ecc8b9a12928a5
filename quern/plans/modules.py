"""Imports every module that registers queries."""

import importlib

NAMES = ("labels", "etl", "analytics", "sequences", "similarity", "supervision", "texts", "flows", "further", "clusters")


def load() -> None:
    for name in NAMES:
        importlib.import_module(f"quern.plans.{name}")
