"""Builds ``queries()`` and ``oracle_sql()`` from the registered query modules."""

from __future__ import annotations

import importlib

from pairlab.plans.registry import ORACLES, QUERIES

MODULES = ["q_scores", "q_mr", "q_noise", "q_profile", "q_runs", "q_encode", "q_sources", "q_stream"]


def _load():
    for m in MODULES:
        importlib.import_module(f"pairlab.plans.{m}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return {k: f() for k, f in ORACLES.items()}
