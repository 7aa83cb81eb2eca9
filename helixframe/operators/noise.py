"""Sequence and vector perturbations with replayable md5 draws.

The original model names these knobs (mutation rate, drop rate, mask rate,
global and local noise strength) without publishing their bodies; the
definitions here are ours and documented in the README.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.hashing import gaussian, uniform
from helixframe.operators.encode import MASK_ID


def mutate_dna(seq: Column, seed: int, keys: list[Column], rate: float) -> Column:
    """Each letter (1-based position i) with u < rate becomes another of ACGT."""
    def letter(i):
        cur = F.substring(seq, i, 1)
        alt = F.substring(F.regexp_replace(F.lit("ACGT"), cur, F.lit("")),
                          (F.floor(uniform(F.lit(seed), F.lit("alt"), *keys, i) * 3) + 1).cast("int"), 1)
        return F.when(uniform(F.lit(seed), F.lit("mut"), *keys, i) < rate, alt).otherwise(cur)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(seq)), letter), "")


def drop_tokens(ids: Column, seed: int, keys: list[Column], rate: float) -> Column:
    """Drop position i (0-based) when u < rate."""
    return F.filter(ids, lambda x, i: uniform(F.lit(seed), F.lit("drop"), *keys, i) >= rate)


def mask_tokens(ids: Column, seed: int, keys: list[Column], rate: float) -> Column:
    """Replace position i with the mask id when u < rate."""
    return F.transform(ids, lambda x, i: F.when(
        uniform(F.lit(seed), F.lit("tmask"), *keys, i) < rate, F.lit(MASK_ID)).otherwise(x))


def gaussian_noise(vec: Column, seed: int, keys: list[Column], global_std: float,
                   local_std: float) -> Column:
    """X * (1 + local_std * g1) + global_std * g2, per dimension."""
    return F.transform(vec, lambda x, i: x * (F.lit(1.0) + F.lit(local_std) * gaussian(F.lit(seed), F.lit("local"), *keys, i))
                       + F.lit(global_std) * gaussian(F.lit(seed), F.lit("global"), *keys, i))
