"""Counter-based random draws: a pure function of its arguments, so retried tasks repeat them."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(part)


def hash_hex(*parts) -> Column:
    """32 hex digits from the colon-joined parts; also usable as a random sort key."""
    return F.md5(F.concat_ws(":", *[_as_column(p).cast("string") for p in parts]))


def draw_index(n: Column, *parts, portable: bool = False) -> Column:
    """Uniform index in [0, n). The portable form gives the same number in any SQL engine."""
    if portable:
        number = F.conv(F.substring(hash_hex(*parts), 1, 8), 16, 10).cast("long")
    else:
        number = F.xxhash64(*[_as_column(p) for p in parts])
    return F.pmod(number, n.cast("long"))
