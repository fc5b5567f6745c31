"""Evaluate an intermediate value once inside one expression.

A column used inside the lambda of an array function is evaluated for every
element, and the optimizer may inline a helper column that is referenced once.
Passing the value through a one-element array makes it a lambda variable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
