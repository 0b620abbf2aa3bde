"""Windows of listed steps, probabilities, ensemble statistics and extreme-forecast indices."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import functions as fn
from ..cube import Cube


def window_operation(cube: Cube, how: str, windows: dict[str, Sequence], dim: str = "step", name: str = "window") -> Cube:
    """Reduce ``dim`` over named windows, each a list of labels; windows may overlap.

    A label's windows are looked up in a literal map, so rows only multiply by the
    windows that hold them and nothing is joined.
    """
    held: dict = {}
    for window, labels in windows.items():
        for x in labels:
            held.setdefault(x, []).append(window)
    table = F.create_map(*[y for x, names in held.items() for y in (F.lit(x), F.array(*[F.lit(n) for n in names]))])
    rest = [d for d in cube.dims if d != dim]
    df = cube.df.where(F.col(dim).isin(list(held))).withColumn(name, F.explode(F.element_at(table, F.col(dim))))
    df = df.groupBy(*rest, name, *cube.inner).agg(*[fn.reduction(how)(F.col(v)).alias(v) for v in cube.values])
    return cube._new(df, dims=[*rest, name], coords={**cube.coords, name: list(windows)})


def in_windows(cube: Cube, length: int, every: int, dim: str = "step", name: str = "window") -> Cube:
    """Each row once for each window of ``length`` whole numbers that holds its label; window k begins at k * ``every``.

    The windows are those of all labels from 0 on, computed row by row.
    """
    last = F.floor(F.col(dim) / every)
    first = F.greatest(F.lit(0), F.floor((F.col(dim) - length) / every) + 1)
    df = cube.df.where((F.col(dim) >= 0) & (first <= last)).withColumn(name, F.explode(F.sequence(first, last)))
    return cube._new(df, dims=[*cube.dims, name])


def running_windows(cube: Cube, how: str, length: int, every: int, dim: str = "step", name: str = "window") -> Cube:
    """Reduce ``dim`` over windows of ``length`` that begin at each multiple of ``every``, as far as the labels go."""
    return in_windows(cube, length, every, dim, name).reduce(how, dim)


def threshold_prob(cube: Cube, compare: str, threshold: float, dim: str = "member") -> Cube:
    """The percentage of labels of ``dim`` whose value compares true with the threshold."""
    test = fn.comparison(compare)
    return cube.reduce(lambda v: F.avg(test(v, F.lit(threshold)).cast("double")) * 100, dim)


def ensms(cube: Cube, dim: str = "member") -> Cube:
    """Mean and standard deviation in one pass: values ``mean`` and ``std``."""
    (value,) = cube.values
    rest = [d for d in cube.dims if d != dim]
    df = cube.df.groupBy(*rest, *cube.inner).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return cube._new(df, dims=rest, values=["mean", "std"])


def climatology(cube: Cube, dims: Sequence[str], parts: int = 100) -> Cube:
    """The quantiles 0/parts .. parts/parts over ``dims``, as one array value ``q``."""
    (value,) = cube.values
    rest = [d for d in cube.dims if d not in dims]
    at = F.array(*[F.lit(k / parts) for k in range(parts + 1)])
    return cube._new(cube.df.groupBy(*rest, *cube.inner).agg(F.percentile(value, at).alias("q")), dims=rest, values=["q"])


def efi_weights(parts: int = 100) -> list[float]:
    """Weights at k/parts of the trapezoid rule for dp / sqrt(p (1 - p)), exact for that factor."""
    a = [2 * math.asin(math.sqrt(k / parts)) for k in range(parts + 1)]
    return [(a[min(k + 1, parts)] - a[max(k - 1, 0)]) / 2 for k in range(parts + 1)]


def extreme(forecast: Cube, clim: Cube, dim: str = "member", sot: Sequence[int] = (10, 90), eps: float = 1e-4, parts: int = 100) -> Cube:
    """Extreme-forecast index and shifts of tails against climatological quantiles (``climatology``).

    EFI = 2/pi * integral of (p - F(p)) / sqrt(p (1 - p)), where F(p) is the share of
    members below the climatological p-quantile.  SOT(90) = (Q(90) - C(99)) / (C(99)
    - C(90)) with the forecast's and the climatology's quantiles, SOT(10) likewise
    with C(1) and C(10); a denominator smaller than ``eps`` gives null.  Values: efi, sot10, sot90 and so on.
    """
    (value,) = forecast.values
    rest = [d for d in forecast.dims if d != dim]
    keys = [*clim.dims, *clim.inner]
    w = efi_weights(parts)
    # A cell's members come together first, so its quantiles meet it once and not once a member.
    aggs: list[Column] = [F.collect_list(value).alias("__all"), F.count(F.lit(1)).alias("__n")]
    aggs += [F.percentile(value, k / 100).alias(f"__f{k}") for k in sot]
    df = forecast.df.groupBy(*rest, *forecast.inner).agg(*aggs).join(clim.df.select(*keys, F.col("q").alias("__q")), keys)

    def below(v: Column) -> Column:
        weighed = F.arrays_zip(F.col("__q").alias("q"), F.array(*[F.lit(x) for x in w]).alias("w"))
        return F.aggregate(weighed, F.lit(0.0), lambda s, x: s + F.when(v < x["q"], x["w"]).otherwise(0.0))

    whole = sum(x * k / parts for k, x in enumerate(w))
    share = F.aggregate("__all", F.lit(0.0), lambda s, v: s + below(v)) / F.col("__n")
    df = df.withColumn("efi", (F.lit(whole) - share) * (2 / math.pi))
    for k in sot:
        tail = 1 if k < 50 else 99
        far, near = (F.get("__q", F.lit(x * parts // 100)) for x in (tail, k))
        df = df.withColumn(f"sot{k}", F.when(F.abs(far - near) >= eps, (F.col(f"__f{k}") - far) / F.when(far != near, far - near)))
    df = df.select(*rest, *forecast.inner, "efi", *[f"sot{k}" for k in sot])
    return forecast._new(df, dims=rest, values=["efi", *[f"sot{k}" for k in sot]])
