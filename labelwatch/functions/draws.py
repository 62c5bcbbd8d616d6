"""Hash-keyed draws: every random choice is a pure function of a seed, a tag and the row id.

A lost executor therefore recomputes the same draw, and any SQL engine with md5
can reproduce it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX8 = 4294967296.0
DIGEST_BITS = 60


def digest(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ``|``; plain Python values are literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hex_uniform(md5_hex: Column) -> Column:
    """First 32 bits of a digest as a double in [0, 1)."""
    return F.conv(F.substring(md5_hex, 1, 8), 16, 10).cast("double") / F.lit(HEX8)


def digest_long(*parts: Column | str | int) -> Column:
    """The first 60 bits of a digest as a number: in the order of the digests, as long as no two of them are equal."""
    return F.conv(F.substring(digest(*parts), 1, DIGEST_BITS // 4), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    return hex_uniform(digest(*parts))


def drawn(share: float, *parts: Column | str | int) -> Column:
    """Is the ``uniform`` of the parts below the share? Compared as hexadecimal text, without a number for each row."""
    return digest(*parts) < f"{math.ceil(share * HEX8):08x}" if share < 1 else F.lit(True)


def pick(n: Column | int, *parts: Column | str | int) -> Column:
    """A slot in 0..n-1."""
    bound = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(*parts) * bound).cast("bigint")
