"""Integer codes of feature values, and the categorical signature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecscore.functions.features import clamp
from vecscore.schema import SCALE, SENTINEL


def code(x: Column) -> Column:
    """-SCALE for exactly -1, else the value limited to [0, 1] times SCALE, rounded half up."""
    return F.when(x == SENTINEL, -SCALE).otherwise(F.round(clamp(x) * SCALE)).cast("int")


def codes(vector: Column) -> Column:
    """code() of each element."""
    return F.transform(vector, code)


def signature(vector: Column) -> Column:
    """Four bits: has history (dimension 5), online (9), card present (10), unknown merchant (11)."""
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    v = lambda i: vector[i]
    return (bit(v(5) != SENTINEL, 1) + bit(v(9) >= 0.5, 2) + bit(v(10) >= 0.5, 4) + bit(v(11) >= 0.5, 8)).cast("int")


def signature_of_codes(c: Column) -> Column:
    """The same from codes."""
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    half = SCALE // 2
    return (bit(c[5] != -SCALE, 1) + bit(c[9] >= half, 2) + bit(c[10] >= half, 4) + bit(c[11] >= half, 8)).cast("int")


def signature_bound(a: Column, b: Column) -> Column:
    """Least squared distance between vectors of two signatures, if their flags are exactly 0 or 1.

    History differs in two dimensions, each other flag in one.
    """
    x = a.bitwiseXOR(b)
    bits = x.bitwiseAND(F.lit(1)) * 2 + F.shiftright(x, 1).bitwiseAND(F.lit(1)) + F.shiftright(x, 2).bitwiseAND(F.lit(1)) + F.shiftright(x, 3).bitwiseAND(F.lit(1))
    return bits.cast("bigint") * (SCALE * SCALE)
