"""Keyed randomness: a draw depends on (seed, tag, key) and on nothing else.

The value is the first 52 bits of an md5 digest, so any engine with md5 gives the
same number and no result depends on partitioning or on a retried task.
"""

from __future__ import annotations

import hashlib
import math
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def uniform(seed, tag, *key) -> Column:
    """Uniform on [0, 1) with 52 random bits. ``seed`` and ``tag`` may be columns."""
    parts = [_text(seed), _text(tag)] + [_text(F.col(k) if isinstance(k, str) else k) for k in key]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def uniform_of(tag: str, key) -> Column:
    """Uniform keyed by ``tag|key`` (the form used by the study fixtures)."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{tag}|"), k.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def normal(seed, tag, *key) -> Column:
    """Standard normal from two keyed uniforms (Box-Muller)."""
    u1 = uniform(seed, _join(tag, "a"), *key)
    u2 = uniform(seed, _join(tag, "b"), *key)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)


def _join(tag, part: str):
    return F.concat(tag.cast("string"), F.lit(part)) if isinstance(tag, Column) else f"{tag}{part}"


# The same draws as plain numbers, for parameters of which a fit has few.


def uniform_value(seed, tag: str, *key) -> float:
    digest = hashlib.md5("|".join(str(p) for p in (seed, tag, *key)).encode()).hexdigest()
    return int(digest[:13], 16) / 4503599627370496.0


def normal_value(seed, tag: str, *key) -> float:
    u1, u2 = uniform_value(seed, f"{tag}a", *key), uniform_value(seed, f"{tag}b", *key)
    return math.sqrt(-2.0 * math.log(1.0 - u1)) * math.cos(2 * math.pi * u2)


def chisq_value(df: float, seed, tag: str, *key) -> float:
    """Chi-square by accept-reject for gamma laws (cube of a normal); attempt k has its own keyed draws.

    More than 95 % of attempts are taken, so few hashes serve any number of degrees of freedom.
    """
    shape, boost = df / 2, 1.0
    if shape < 1:
        boost = max(uniform_value(seed, f"{tag}|boost", *key), 2.0**-53) ** (1 / shape)
        shape += 1
    d = shape - 1 / 3
    c = 1 / math.sqrt(9 * d)
    for k in count(1):
        x, u = normal_value(seed, f"{tag}|x", *key, k), uniform_value(seed, f"{tag}|u", *key, k)
        v = (1 + c * x) ** 3
        if v > 0 and (u == 0 or math.log(u) < 0.5 * x * x + d - d * v + d * math.log(v)):
            return 2 * d * v * boost
