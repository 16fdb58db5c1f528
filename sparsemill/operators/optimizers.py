"""Weight updates: plain gradient steps, and adaptive steps by powers of accumulated squares, exact or by table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import Rates

#: Bits of a float's exponent and first fraction bits that index the table of rates.
TABLE_BITS = 11


class Optimizer:
    """update(gradient, accumulators) gives steps and changes the accumulators in place. Single precision."""

    def __init__(self, kind: str, rates: Rates):
        self.kind, self.rate = kind, np.float32(rates.learning_rate)
        self.power, self.start = np.float32(-rates.power_t), np.float32(rates.init_acc)
        if kind == "adagrad_lut":
            self.table = rate_table(rates)
            self.start = np.float32(0.0)  # the table has it

    def update(self, g: np.ndarray, acc: np.ndarray) -> np.ndarray:
        if self.kind == "sgd":
            return g * self.rate
        acc += g * g
        if self.kind == "adagrad_lut":
            return g * self.table[acc.view(np.uint32) >> np.uint32(31 - TABLE_BITS)]
        with np.errstate(all="ignore"):
            step = g * self.rate * acc**self.power
        return np.where(np.isfinite(step), step, np.float32(0.0)).astype(np.float32)


def rate_table(rates: Rates) -> np.ndarray:
    """Rates by the leading bits of an accumulator: the mean of the two neighbouring values; the plain rate where that isn't finite."""
    with np.errstate(all="ignore"):
        at = (np.arange((1 << TABLE_BITS) + 1, dtype=np.uint32) << np.uint32(31 - TABLE_BITS)).view(np.float32) + np.float32(rates.init_acc)
        power = at ** np.float32(-rates.power_t)
        out = np.float32(rates.learning_rate) * (power[:-1] + power[1:]) * np.float32(0.5)
    return np.where(np.isfinite(out), out, np.float32(rates.learning_rate)).astype(np.float32)


def initial_acc(kind: str, rates: Rates) -> float:
    return rates.init_acc if kind == "adagrad_flex" else 0.0


def step(kind: str, rates: Rates, g: Column, squares: Column, acc: Column) -> tuple[Column, Column]:
    """A weight's step and new accumulator as columns, for summed gradients g and summed squares."""
    new = acc + squares
    if kind == "sgd":
        return g * rates.learning_rate, acc
    if kind == "adagrad_flex":
        rate = F.pow(new, F.lit(-rates.power_t))
        out = g * rates.learning_rate * rate
        return F.when(F.isnan(out) | (F.abs(out) == F.lit(float("inf"))), F.lit(0.0)).otherwise(out), new
    # The table's two neighbouring values, by cutting the accumulator off after its leading bits.
    exponent = F.floor(F.log2(F.greatest(new, F.lit(2.0**-126))))
    fraction = F.floor((new / F.pow(F.lit(2.0), exponent) - 1) * 8) / 8
    low = F.when(new < 2.0**-126, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), exponent) * (1 + fraction))
    high = F.when(new < 2.0**-126, F.lit(2.0**-127)).otherwise(low + F.pow(F.lit(2.0), exponent) / 8)
    power = lambda x: F.when(x + rates.init_acc > 0, F.pow(x + rates.init_acc, F.lit(-rates.power_t)))
    return g * F.coalesce((power(low) + power(high)) * (0.5 * rates.learning_rate), F.lit(rates.learning_rate)), new
