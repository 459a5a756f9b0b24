"""Keyed hashes: random-looking values that depend on the key alone.

A draw made this way is the same after a task retry, a repartition or a change
of cluster size, which ``rand()`` does not promise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash60(*parts: Column | str | int) -> Column:
    """60-bit non-negative hash of the parts joined by ``|`` (top 15 hex digits of md5)."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *columns))
    # Never null, and saying so keeps the optimizer from repeating the hash in a null filter.
    return F.coalesce(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(0))
