"""Reproducible pseudo-random draws: functions of a row's key, never of its partition."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MODULUS = 2_147_483_647


def key_hash(*cols: Column | str, seed: int = 42) -> Column:
    """Uniform integer in [0, MODULUS) from key columns and a seed."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(MODULUS))


def unit_hash(*cols: Column | str, seed: int = 42) -> Column:
    """Uniform double in (0, 1)."""
    return (key_hash(*cols, seed=seed) + F.lit(0.5)) / F.lit(float(MODULUS))


def normal_hash(*cols: Column | str, seed: int = 42) -> Column:
    """Standard normal draw (Box and Muller 1958)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(unit_hash(*cols, seed=seed)))
    return radius * F.cos(F.lit(6.283185307179586) * unit_hash(*cols, seed=seed + 1))
