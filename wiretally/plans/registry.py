"""All registered queries and their oracle SQL, by operator id."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("q_flow", "q_alerts", "q_logs", "q_hourly", "q_scores", "q_detect", "q_models", "q_store", "q_streams")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        try:
            module = import_module(f"wiretally.plans.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"wiretally.plans.{name}":
                raise
            continue
        out.update(getattr(module, attribute))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
