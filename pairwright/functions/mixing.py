"""One integer hash of 32 bits that Spark, SQL and numpy compute alike.

Two rounds of a shift and a product that stays below 2**63, so that it is exact in
signed 64-bit arithmetic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
_FACTOR = 0x45D9F3B


def mixed(x: Column) -> Column:
    """The hash of a long from 0 to 2**32 - 1."""
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftrightunsigned(x, 16)) * F.lit(_FACTOR).cast("long")).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def mixed_sql(name: str) -> str:
    """The same in SQL, of a column."""
    for _ in range(2):
        name = f"((xor({name}, {name} >> 16) * {_FACTOR}) & {MASK})"
    return f"xor({name}, {name} >> 16)"


def mixed_array(x: np.ndarray) -> np.ndarray:
    """The same of an array of uint32."""
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(_FACTOR)
    return x ^ (x >> np.uint32(16))


def mixed_int(x: int) -> int:
    for _ in range(2):
        x = ((x ^ (x >> 16)) * _FACTOR) & MASK
    return x ^ (x >> 16)
