"""All queries of the library, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("graphs", "signals", "subjects", "cohort", "covariates", "measured", "models", "ensembles", "sweeps", "screenings", "statements")


def _merged(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"latticework.plans.{name}"), kind)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
