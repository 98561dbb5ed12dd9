"""Importing this module registers every bound query."""

import importlib

from ledgerweave.plans.registry import ORACLES, QUERIES

for _part in [
    "bound_market",
    "bound_state",
    "bound_wallets",
    "bound_reconcile",
    "bound_events",
    "bound_decode",
    "bound_inbox",
    "bound_quality",
    "bound_stream",
    "bound_live",
    "bound_guards",
    "bound_products",
    "bound_kept",
]:
    importlib.import_module(f"ledgerweave.plans.{_part}")

__all__ = ["ORACLES", "QUERIES"]
