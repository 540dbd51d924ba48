"""Deterministic pseudo-random numbers.

Draws are a function of (seed, key...) only, so results do not depend on
partitioning or task retries, and an independent SQL engine can repeat them:
u = int(first 8 hex digits of md5('seed:k1:k2...'), 16) / 2**32, in [0, 1).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystack.functions._util import col_of


def hash_text(seed, *keys) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col_of(k).cast("string") for k in keys]))


def hash_uniform(seed, *keys) -> Column:
    h = F.substring(hash_text(seed, *keys), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)
