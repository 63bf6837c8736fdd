"""Random numbers that are a function of the row's key.

A generator with state gives a row a different number whenever partitioning, task retry or the
cluster size changes. These numbers depend on (keys, salt, seed) only, so a lost executor or a
repartition reproduces exactly the same draws. xxHash64 is a few arithmetic steps inside generated
code, and any SQL engine with 128-bit integers can replay it.
"""

from math import pi
from zlib import crc32

from pyspark.sql import Column, functions as F

# 48 bits: the largest number times any total still stays below that total in a double.
BITS = 48


def stream(salt: str, seed: int) -> int:
    """The whole number that tells one stream of numbers from another."""
    return crc32(f"{salt}|{seed}".encode())


def uniform(*keys: Column | str, salt: str, seed: int = 0) -> Column:
    """A number in [0, 1) from the upper 48 bits of the row's hash. Keys are whole numbers."""
    parts = [F.col(key) if isinstance(key, str) else key for key in keys]
    hashed = F.xxhash64(
        *[part.cast("bigint") for part in parts], F.lit(stream(salt, seed)).cast("bigint")
    )
    return F.shiftrightunsigned(hashed, 64 - BITS) / F.lit(float(2**BITS))


def normal(*keys: Column | str, mean: float, sd: float, salt: str, seed: int = 0) -> Column:
    """A normal draw by the Box-Muller transform of two keyed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - uniform(*keys, salt=salt + ".r", seed=seed)))
    angle = F.lit(2.0 * pi) * uniform(*keys, salt=salt + ".a", seed=seed)
    return F.lit(mean) + F.lit(sd) * radius * F.cos(angle)
