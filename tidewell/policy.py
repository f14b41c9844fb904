"""Frozen parameters of the panel pipeline; `digest` identifies a set of them."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass


# fixed values: the parameters below are part of the definitions, not tuned here


@dataclass(frozen=True)
class PanelPolicy:
    signals: tuple[str, ...] = ("click", "error", "purchase", "signup", "view")
    trigger_signal: str = "error"
    trigger_value: float = 130.0
    missing_tokens: tuple[str, ...] = ("", "NaN", "nan", "NA", "N/A", "null", "NULL")


@dataclass(frozen=True)
class TargetPolicy:
    onset_shift: int = 6
    horizon: int = 6
    last_observation_age: int = 24
    rolling_hours: int = 8


@dataclass(frozen=True)
class AlarmPolicy:
    refractory: int = 6
    useful_from: int = 6
    useful_to: int = 1
    most_false_per_day: float = 0.25
    grid: tuple[int, ...] = tuple(range(1, 101))


@dataclass(frozen=True)
class UtilityPolicy:
    """Published weights of the challenge score: see operators.decision."""

    early: int = -12
    optimal: int = -6
    late: int = 3
    best_true: float = 1.0
    worst_miss: float = -2.0
    false_alarm: float = -0.05


@dataclass(frozen=True)
class ModelPolicy:
    folds: int = 5
    inner_folds: int = 3
    ridge: float = 1.0
    top_signals: int = 20
    least_coverage: float = 0.05
    least_entities: int = 1000
    rounds: int = 600
    patience: int = 30
    seeds: tuple[int, ...] = (0, 101, 202)
    balances: tuple[str, ...] = ("entity", "row", "class")
    bootstrap: int = 300
    curve: tuple[int, ...] = (5, 10, 15, 20, 25, 30, 35, 40, 45, 50)


def digest(*policies) -> str:
    """sha256 of the policies' canonical JSON."""
    said = json.dumps({type(p).__name__: dataclasses.asdict(p) for p in policies}, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(said.encode()).hexdigest()
