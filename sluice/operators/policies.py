"""Scheduling policies: which of the ready keys run in a wave.

A policy is a function of (ready [(key, cost class)], used ticks, wave) that returns
("run", keys) or ("yield", reason).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

Ready = list[tuple[str, str]]
Decision = tuple[str, list[str] | str]


class Unlawful(ValueError):
    """A selection that is empty without a yield, or names a key that is not ready."""


def _budgeted(ceilings: dict[str, int]) -> Callable[[Ready, Counter, int], Decision]:
    def decide(ready: Ready, used: Counter, wave: int) -> Decision:
        taken, keys = Counter(), []
        for key, cost in ready:
            if cost not in ceilings or used[cost] + taken[cost] < ceilings[cost]:
                taken[cost] += 1
                keys.append(key)
        return ("run", keys) if keys else ("yield", "budget")

    return decide


def _defer_costly(order: list[str]) -> Callable[[Ready, Counter, int], Decision]:
    rank = lambda cost: (order.index(cost), "") if cost in order else (len(order), cost)

    def decide(ready: Ready, used: Counter, wave: int) -> Decision:
        best = min(rank(cost) for _, cost in ready)
        return "run", [key for key, cost in ready if rank(cost) == best]

    return decide


def _script(waves: list) -> Callable[[Ready, Counter, int], Decision]:
    def decide(ready: Ready, used: Counter, wave: int) -> Decision:
        if wave >= len(waves):
            return "yield", "script-exhausted"
        step = waves[wave]
        if isinstance(step, dict):
            return "yield", step["yield"]
        return "run", [k for k, _ in ready] if step == "all" else list(step)

    return decide


def policy(name: str = "quiescence", config: dict | None = None) -> Callable[[Ready, Counter, int], Decision]:
    config = config or {}
    every = lambda ready, used, wave: ("run", [k for k, _ in ready])
    made = {
        "quiescence": lambda: every,
        "single-wave": lambda: lambda ready, used, wave: every(ready, used, wave) if wave == 0 else ("yield", "single-wave"),
        "defer-costly": lambda: _defer_costly([c for c in config.get("order", []) if isinstance(c, str)]),
        "budgeted": lambda: _budgeted({k: v for k, v in config.get("ceilings", {}).items() if type(v) is int}),
        "script": lambda: _script(config.get("waves", [])),
    }
    if name not in made:
        raise KeyError(f"unknown policy {name}")
    return made[name]()


def lawful(keys: list[str], ready: Ready) -> None:
    if not keys or set(keys) - {k for k, _ in ready}:
        raise Unlawful("an empty selection or a key that is not ready")
