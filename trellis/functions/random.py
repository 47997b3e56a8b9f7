"""Seeded random columns that do not depend on partitioning.

``rand(seed)`` changes with the partition layout, so a retried or rescaled job
would draw new numbers.  Every draw here is a pure function of the row key, the
seed and a salt: the first 8 hex digits of ``md5("key:seed:salt")`` read as an
unsigned 32-bit number.  DuckDB computes the same number with
``CAST('0x' || substr(md5(s), 1, 8) AS BIGINT)``, which keeps the oracle exact.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _as_col(part) -> Column:
    """Columns and column names as text; other literals (numbers) as text.

    Text salts must be passed as ``F.lit("salt")``: a bare string is a column name.
    """
    if isinstance(part, Column):
        return part.cast("string")
    if isinstance(part, str):
        return F.col(part).cast("string")
    return F.lit(str(part))


def key_string(*parts) -> Column:
    """``a:b:c`` text of the given columns / literals (literals pass as text)."""
    return F.concat_ws(":", *[_as_col(p) for p in parts])


def hash32(*parts) -> Column:
    """Unsigned 32-bit number from md5 of the ``:``-joined parts."""
    return F.conv(F.substring(F.md5(key_string(*parts)), 1, 8), 16, 10).cast("bigint")



def uniform(*parts) -> Column:
    """U[0,1) draw; ``uniform(key, seed, F.lit('salt'))``."""
    return hash32(*parts) / F.lit(TWO32)



def normal(*parts) -> Column:
    """Standard normal by Box-Muller from two 32-bit slices of one md5."""
    k = F.md5(key_string(*parts))
    u1 = (F.conv(F.substring(k, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(TWO32)
    u2 = (F.conv(F.substring(k, 9, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(TWO32)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)



# ---------------------------------------------------------------- per-run draws
# md5 is ~5 us per row; a 30-run holdout would pay it 30 times per row.  Instead
# the row key is hashed once (``hash32``) and each seed gets its own draw by an
# integer mixer.  Every product stays below 2^63, so DuckDB (which raises on
# BIGINT overflow) computes exactly the same numbers as Spark.

MIX_MULT = 73244475            # 0x45d9f3b, a 32-bit avalanche multiplier
SEED_STEP = 2654435769         # 0x9e3779b9, golden-ratio step between seeds
MOD32 = 4294967296


def mix32(x: Column) -> Column:
    """Avalanche a 32-bit value (two xor-shift-multiply rounds, mod 2^32)."""
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(MIX_MULT)) % F.lit(MOD32)
    return F.shiftright(x, 16).bitwiseXOR(x)


def seeded_hash(key_hash: Column | str, seed: Column | str | int) -> Column:
    """32-bit draw for (row, seed) from the row's ``hash32`` of its key."""
    h = F.col(key_hash) if isinstance(key_hash, str) else key_hash
    s = F.col(seed) if isinstance(seed, str) else (seed if isinstance(seed, Column)
                                                   else F.lit(int(seed)))
    return mix32((h + s.cast("bigint") * F.lit(SEED_STEP)) % F.lit(MOD32))


def seeded_draws(key_hash: np.ndarray, seed: int) -> np.ndarray:
    """The draws of :func:`seeded_hash` for an array of row hashes (bigint)."""
    x = np.fmod(key_hash + np.int64(seed * SEED_STEP), np.int64(MOD32))
    for _ in range(2):
        x = np.fmod(((x >> 16) ^ x) * np.int64(MIX_MULT), np.int64(MOD32))
    return (x >> 16) ^ x


def sql_mix32(x: str) -> str:
    for _ in range(2):
        x = f"((xor(({x}) >> 16, ({x})) * {MIX_MULT}) % {MOD32})"
    return f"xor(({x}) >> 16, ({x}))"


def sql_seeded_hash(key_hash: str, seed: str) -> str:
    """DuckDB twin of :func:`seeded_hash`."""
    return sql_mix32(f"(({key_hash}) + CAST({seed} AS BIGINT) * {SEED_STEP}) % {MOD32}")
