"""Learning-rate schedules and step cadence as expressions on a step column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardloom.constants import DECAY_FRACTION, TUNING_WARMUP_STEPS, WARMUP_FRACTION


def stable_start(n: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(n * F.lit(WARMUP_FRACTION)))


def decay_steps(n: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(n * F.lit(DECAY_FRACTION)))


def decay_start(n: Column) -> Column:
    return n - decay_steps(n)


def wsd_lr(step: Column, n: Column) -> Column:
    """Warm up, stay at 1, fall linearly to 0."""
    return (
        F.when(step < stable_start(n), (step + 1) / stable_start(n))
        .when(step < decay_start(n), F.lit(1.0))
        .otherwise(1.0 - (step - decay_start(n)) / decay_steps(n))
    )


def phase(step: Column, n: Column) -> Column:
    return F.when(step < stable_start(n), "warmup").when(step < decay_start(n), "stable").otherwise("decay")


def warmup_flat_lr(step: Column, lr: float, warmup: int = TUNING_WARMUP_STEPS) -> Column:
    return F.when(step < warmup, F.lit(lr) * (step + 1) / F.lit(warmup)).otherwise(F.lit(lr))


def one_cycle_lr(
    step: Column, n: Column, peak: float, rise: float = 0.05, start_div: float = 25.0, end_div: float = 1e4
) -> Column:
    """The published one-cycle schedule: cosine up over ``rise`` of the steps, cosine down after."""
    low = peak / start_div
    floor = low / end_div
    top = n * F.lit(rise) - 1.0
    up = F.coalesce(F.try_divide(step, top), F.lit(1.0))
    down = F.coalesce(F.try_divide(step - top, n - 1 - top), F.lit(1.0))

    def cosine(a: float, b: float, part: Column) -> Column:
        return F.lit(b) + F.lit((a - b) / 2.0) * (F.cos(part * F.lit(math.pi)) + 1.0)

    return F.when(step <= top, cosine(low, peak, up)).otherwise(cosine(peak, floor, down))


def is_last(step: Column, n: Column) -> Column:
    return step == n - 1


def validates(step: Column, n: Column, every: int) -> Column:
    return (step % every == 0) | is_last(step, n)


def generates(step: Column, n: Column, every: int) -> Column:
    return ((step % every == 0) & (step > 0)) | is_last(step, n)


def checkpoints(step: Column, n: Column, every: int) -> Column:
    return (step > 0) & ((step % every == 0) | is_last(step, n))
