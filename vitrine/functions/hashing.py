"""Reproducible randomness as column expressions.

Every draw is a pure function of its key (seed, user, step, ...), so results do
not depend on partitioning and survive task retries unchanged.
"""

import math

from pyspark.sql import Column, functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash60(*parts) -> Column:
    """60-bit non-negative integer from the md5 of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Double in [0, 1]."""
    return hash60(*parts).cast("double") / F.lit(2.0**60)


def normal(*parts) -> Column:
    """Standard normal by the Box-Muller transform of two hashed uniforms."""
    radius = (hash60(*parts, "a") + F.lit(1)).cast("double") / F.lit(2.0**60)
    angle = uniform(*parts, "b")
    return F.sqrt(F.log(radius) * -2.0) * F.cos(angle * (2.0 * math.pi))


def draw_int(low, high, *parts) -> Column:
    """Integer in [low, high)."""
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return (low + hash60(*parts) % (high - low)).cast("int")
