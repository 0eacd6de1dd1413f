"""Sample arrays: fades, silences and joins, as higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def microfade(samples: Column, rate: int, ms: int) -> Column:
    """Linear fades of ms at both ends, at most half of the samples each; null stays null."""
    n = F.size(samples)
    fade = F.least(F.lit(max(1, rate * ms // 1000)), F.floor(n / 2))

    def faded(v: Column, i: Column) -> Column:
        left = F.when(i < fade, i.cast("float") / fade.cast("float")).otherwise(F.lit(1.0))
        back = n - 1 - i
        right = F.when(back < fade, back.cast("float") / fade.cast("float")).otherwise(F.lit(1.0))
        return (v * left * right).cast("float")

    return F.transform(samples, faded)


def silence(rate: int, ms: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), max(0, rate * ms // 1000))


def join_with_pauses(chunks: list[Column], rate: int, pauses: list[int], fade_ms: int) -> Column:
    """Faded chunks with a pause of pauses[i] ms after chunk i, but none after the last."""
    parts = []
    for i, c in enumerate(chunks):
        parts.append(microfade(c, rate, fade_ms))
        if i + 1 < len(chunks):
            parts.append(silence(rate, pauses[i]))
    return F.concat(*parts)


def _crossfaded(out: Column, after: Column, most: int) -> Column:
    n = F.least(F.lit(most), F.floor(F.least(F.size(out), F.size(after)) / 2)).cast("int")
    kept = F.size(out) - n

    def mixed(v: Column, j: Column) -> Column:
        angle = F.lit(math.pi / 2) * j / F.greatest(n - 1, F.lit(1))
        return (v * F.cos(angle) + F.element_at(after, j + 1) * F.sin(angle)).cast("float")

    tail = F.transform(F.slice(out, kept + 1, n), mixed)
    return F.when(n <= 0, F.concat(out, after)).otherwise(F.concat(F.slice(out, F.lit(1), kept), tail, F.slice(after, n + 1, F.size(after) - n)))


def crossfade(chunks: Column, rate: int, ms: int) -> Column:
    """An array of sample arrays as one, each pair overlapping by ms with equal power, by half of the shorter one at most.

    An overlap of one sample keeps the earlier chunk's sample. No chunks give an empty array; null gives null.
    """
    most = max(0, rate * ms // 1000)
    return F.aggregate(chunks, F.array().cast("array<float>"), lambda out, c: _crossfaded(out, c.cast("array<float>"), most))


def combined(chunks: Column, pauses: Column, rate: int, fade_ms: int, crossfade_ms: int) -> Column:
    """Faded chunks, with a pause of pauses[i] ms after chunk i, or a crossfade where that is not positive."""
    most = max(0, rate * crossfade_ms // 1000)
    parts = F.transform(chunks, lambda c, i: F.struct(F.when(i > 0, F.get(pauses, i - 1)).otherwise(0).alias("pause"), microfade(c.cast("array<float>"), rate, fade_ms).alias("samples")))

    def step(out: Column, part: Column) -> Column:
        gap = F.array_repeat(F.lit(0.0).cast("float"), F.floor(part["pause"] * rate / 1000).cast("int"))
        return F.when(part["pause"] > 0, F.concat(out, gap, part["samples"])).otherwise(_crossfaded(out, part["samples"], most))

    return F.aggregate(parts, F.array().cast("array<float>"), step)
