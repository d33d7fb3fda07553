"""Portable deterministic draws.

``portable_hash`` is the first 32 bits of MD5 of a text key, as an unsigned
BIGINT in [0, 2^32). DuckDB computes the same value with
``('0x' || substr(md5(key), 1, 8))::BIGINT``, so an oracle can reproduce
every draw made with it (bootstrap, synonym choice, shuffle order).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def hash_key(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def portable_hash(*parts: Column | str | int) -> Column:
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, 8), 16, 10).cast("bigint")


def hash_bucket(n_buckets: int, *parts: Column | str | int) -> Column:
    """Bucket in [0, n_buckets) that is monotone in the hash value."""
    return (portable_hash(*parts) * F.lit(n_buckets) / F.lit(HASH_RANGE)).cast("bigint")
