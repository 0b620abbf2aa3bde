"""Functions by name: reductions, arithmetic, comparisons.  Users may register more."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _least(v: Column) -> Column:
    """Minimum in which a NaN wins, as it does in the other reductions."""
    return F.when(F.bool_or(F.isnan(v)), F.lit(math.nan)).otherwise(F.min(v))


def divide(a: Column, b: Column) -> Column:
    """Division by IEEE rules: x / 0 is an infinity, 0 / 0 is NaN."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b != 0, b))


#: name -> aggregate over one value column.
REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "min": _least,
    "max": F.max,
    "prod": F.product,
    "norm": lambda v: F.sqrt(F.sum(v * v)),
    "count": F.count,
}
#: Reductions that may be composed of reductions of batches.
BATCHABLE = {"sum", "mean", "std", "min", "max", "prod"}
#: name -> value of two columns (or a column and a number).
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": divide,
    "power": F.pow,
    "diff": lambda a, b: b - a,
}
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def register(name: str, function: Callable, kind: str = "reduction", batchable: bool = False) -> None:
    """Make ``function`` known by ``name``; kind is "reduction" or "binary".  A known name is replaced with a warning."""
    table = {"reduction": REDUCTIONS, "binary": BINARY}[kind]
    if name in table:
        warnings.warn(f"{kind} {name!r} is replaced", stacklevel=2)
    table[name] = function
    if kind == "reduction":
        (BATCHABLE.add if batchable else BATCHABLE.discard)(name)


def reduction(name: str) -> Callable[[Column], Column]:
    if name not in REDUCTIONS:
        raise ValueError(f"unknown reduction {name!r}")
    return REDUCTIONS[name]


def comparison(name: str) -> Callable[[Column, Column], Column]:
    if name not in COMPARISONS:
        raise ValueError(f"unknown comparison {name!r}")
    return COMPARISONS[name]
