"""Seeded row hashes: random choices that do not depend on partitioning.

A choice is a function of a row's key and the seed, so a lost executor or another
number of partitions gives the same rows again.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from diffmill.constants import SEED


def hash_order(key: Column, seed: int = SEED) -> Column:
    """Hex digest whose order is a random order of the keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")).cast("binary"))


def hash_number(key: Column, seed: int = SEED) -> Column:
    """Uniform integer below 2**32."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint")


def content_key(text: Column) -> Column:
    """Fixed-width stand-in for a text as a shuffle key."""
    return F.sha2(text, 256)
