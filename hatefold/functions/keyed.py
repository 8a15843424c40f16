"""Keyed randomness.

Every random choice is a pure function of a key (seed, row id, attempt, match
position, rule, slot), so results do not depend on partitioning, task retries
or row order. md5 gives the same hex string in Spark and in DuckDB, which keeps
the generators checkable by SQL:

    h(key) = int(first 8 hex digits of md5(concat_ws(':', key...)), 16)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(p) -> Column:
    return p if isinstance(p, Column) else F.lit(p)


def keyed_hash(*parts) -> Column:
    """Non-negative 32-bit integer (as long) derived from the key parts."""
    key = F.concat_ws(":", *[_as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def keyed_choice(n, *parts) -> Column:
    """Uniform choice in [0, n) from the key."""
    return F.pmod(keyed_hash(*parts), _as_col(n).cast("long"))


def hash_order_key(*parts) -> Column:
    """Full md5 hex string, usable as a sort key."""
    return F.md5(F.concat_ws(":", *[_as_col(p).cast("string") for p in parts]))
