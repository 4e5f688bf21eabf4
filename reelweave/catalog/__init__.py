"""Registered queries: each Spark query next to the SQL it must agree with."""

from __future__ import annotations

import importlib

from reelweave.catalog.registry import ORACLE, QUERIES

MODULES = (
    "fusion ranking events_q timeline_q text_q lexical_q vectors_q sequences_q sampling_q contracts_q team_q plans_q tasks_q"
).split()


def load() -> tuple[dict, dict]:
    for module in MODULES:
        importlib.import_module(f"reelweave.catalog.{module}")
    return QUERIES, ORACLE
