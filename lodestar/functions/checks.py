"""Argument checks shared by the operators."""

from __future__ import annotations

import math


def check_fraction(**values: float) -> None:
    for name, value in values.items():
        if not 0 < value < 1:
            raise ValueError(f"{name} must be in (0,1), got {value!r}")


def check_positive(**values: float) -> None:
    for name, value in values.items():
        if not (value > 0 and math.isfinite(value)):
            raise ValueError(f"{name} must be positive and finite, got {value!r}")


def check_at_least(low: int, **values: int) -> None:
    for name, value in values.items():
        if int(value) != value or value < low:
            raise ValueError(f"{name} must be an integer >= {low}, got {value!r}")


def check_frequent_params(phi: float, epsilon: float, delta: float) -> None:
    check_fraction(phi=phi, epsilon=epsilon, delta=delta)
    if epsilon >= phi:
        raise ValueError(f"epsilon must be below phi, got {epsilon!r} >= {phi!r}")
