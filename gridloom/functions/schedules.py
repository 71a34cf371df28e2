"""Learning-rate schedules as expressions of an update number, usable on a column or a plain number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(step: Column, value: float) -> Column:
    return F.when(step.isNotNull(), F.lit(float(value)))


def factor(step: Column, base: float, rate: float, max_updates: int | None = None, minimum: float | None = None) -> Column:
    if rate > 1:
        raise ValueError("the factor may not exceed 1")
    if minimum is not None:
        max_updates = round(math.log(minimum / base) / math.log(rate))
    capped = step if max_updates is None else F.least(step, F.lit(max_updates))
    return F.lit(float(base)) * F.pow(F.lit(float(rate)), capped)


def multi_factor(step: Column, base: float, rate: float, steps: list[int]) -> Column:
    """The base is multiplied once for every limit the step has passed."""
    passed = sum(((step > s).cast("int") for s in steps), F.lit(0))
    return F.lit(float(base)) * F.pow(F.lit(float(rate)), passed)


def linear(step: Column, base: float, slope: float, max_updates: int | None = None, bound: float | None = None) -> Column:
    """``base + step * slope`` until ``max_updates`` or until the value ``bound`` is reached."""
    if bound is not None:
        max_updates = round((bound - base) / slope)
    capped = step if max_updates is None else F.least(step, F.lit(max_updates))
    return F.lit(float(base)) + capped * F.lit(float(slope))


def cosine(step: Column, base: float, max_updates: int, final: float = 0.01) -> Column:
    share = step / F.lit(float(max_updates))
    wave = F.lit(final) + F.lit((base - final) / 2) * (1 + F.cos(F.lit(math.pi) * share))
    return F.when(step > max_updates, F.lit(float(final))).otherwise(wave)


def polynomial(step: Column, base: float, final: float, decay_steps: int, power: float = 1.0) -> Column:
    share = F.greatest(F.lit(0), F.least(step, F.lit(decay_steps))) / F.lit(float(decay_steps))
    return F.lit(base - final) * F.pow(1 - share, F.lit(float(power))) + F.lit(float(final))


def warm_up(step: Column, steps: int, begin: float, main, mode: str = "linear") -> Column:
    """Rise from ``begin`` (or stay there in constant mode), then ``main(step - steps)``."""
    target = main(F.lit(0))
    rise = F.lit(float(begin)) + (target - F.lit(float(begin))) * step / F.lit(float(steps))
    first = rise if mode == "linear" else F.lit(float(begin))
    return F.when(step < steps, first).otherwise(main(step - F.lit(steps)))
