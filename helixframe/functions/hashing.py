"""Replayable pseudo-randomness as column expressions.

Every draw is ``md5`` of the colon-joined key parts, so it depends only on
(seed, purpose, row keys): never on partitioning, retries or the engine.
The same integer is produced by DuckDB with
``('0x' || substr(md5(concat_ws(':', ...)), 1, 8))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0

# Hex digit d of an md5 maps to letter d mod 4 of "ACGT".
HEX_DIGITS = "0123456789abcdef"
HEX_TO_ACGT = "ACGTACGTACGTACGT"


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash_u32(*parts) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of md5(key)."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform in [0, 1) from md5 of the key parts."""
    return hash_u32(*parts) / F.lit(TWO32)


def gaussian(*parts) -> Column:
    """Standard normal draw by Box-Muller on two hash uniforms."""
    u1 = (hash_u32(*parts, "g1") + F.lit(1.0)) / F.lit(TWO32 + 1.0)
    u2 = uniform(*parts, "g2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def acgt_string(id_col: Column) -> Column:
    """64-letter DNA string of an integer id: md5(id) || md5(id || 'b')."""
    s = id_col.cast("string")
    hexes = F.concat(F.md5(s), F.md5(F.concat(s, F.lit("b"))))
    return F.translate(hexes, HEX_DIGITS, HEX_TO_ACGT)
