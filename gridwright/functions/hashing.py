"""Deterministic randomness: every draw is a function of (row key, salt, seed), so a result does
not change when the data is repartitioned, retried or read in another order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def key_hash(keys: Sequence, salt="", seed: int = 42) -> Column:
    """Hex md5 of ``key|...|salt|seed``; the text form is the same in other SQL engines."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", *[_text(c) for c in cols], _text(salt), F.lit(str(seed))))


def hex_uniform(hashed: Column, start: int = 1) -> Column:
    """13 hex digits of a hash as a double in [0, 1)."""
    return F.conv(F.substring(hashed, start, 13), 16, 10).cast("double") / F.lit(float(2**52))


def uniform(keys: Sequence, salt="", seed: int = 42) -> Column:
    return hex_uniform(key_hash(keys, salt, seed))


def gaussian(keys: Sequence, salt="", seed: int = 42) -> Column:
    """Standard normal by Box-Muller from the two halves of one hash."""
    h = key_hash(keys, salt, seed)
    u1 = F.greatest(hex_uniform(h, 1), F.lit(2.0**-52))
    u2 = hex_uniform(h, 17)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def pick(keys: Sequence, n: int, salt="", seed: int = 42) -> Column:
    """Integer in [0, n)."""
    return F.floor(uniform(keys, salt, seed) * F.lit(n)).cast("int")
