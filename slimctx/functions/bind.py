"""Bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often ``body`` reads it.

    The value is a lambda variable, which the optimizer never inlines.  An
    outer column that a lambda reads is replaced by its definition instead and
    is then computed once per array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def record(**fields: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in fields.items()])
