"""Salted equi-join: one plan for every size and every distribution of keys.

A hub file is reached from a large share of all entries, so one key can hold
a third of the big side.  The big side is dealt out by key and a salt hashed
from its whole row, the small side is repeated once per salt; a key's rows
then spread over ``SALTS`` tasks whatever their number.  The small sides are
slim (edges, token counts), never file texts.  Nothing is counted, collected
or broadcast by hand; adaptive execution may still broadcast a side that it
has measured to be small, or split a partition further."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``big.join(small, on, how)`` (inner or left) with the keys salted."""
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    every = small.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return salted.join(every, [*on, "_salt"], how).drop("_salt")
