"""Cubes from tables, packed arrays, several parts, or files whose names hold coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube


def from_frame(df: DataFrame, dims: Sequence[str], inner: Sequence[str] = (), values: Sequence[str] = ("v",), coords: dict | None = None) -> Cube:
    """A cube over a tidy table; floats become doubles."""
    kinds = dict(df.dtypes)
    df = df.select(*dims, *inner, *[F.col(v).cast("double").alias(v) if kinds[v] == "float" else F.col(v) for v in values])
    return Cube(df, dims, inner, values, coords)


def from_arrays(df: DataFrame, dims: Sequence[str], array_col: str, inner: str = "i", value: str = "v", coords: dict | None = None) -> Cube:
    """A cube from one array a cell; ``inner`` numbers its elements from 0."""
    df = df.select(*dims, F.posexplode(array_col).alias(inner, value))
    return Cube(df.withColumn(value, F.col(value).cast("double")), dims, [inner], [value], coords)


def from_parts(parts: Sequence[DataFrame], coords: dict[str, Sequence], inner: Sequence[str] = (), values: Sequence[str] = ("v",)) -> Cube:
    """A cube from one table a cell, in the order of the product of ``coords``."""
    cells = list(product(*coords.values()))
    if len(cells) != len(parts):
        raise ValueError(f"{len(parts)} parts for {len(cells)} cells")
    out = None
    for cell, part in zip(cells, parts, strict=True):
        part = part.select(*[F.lit(x).alias(d) for d, x in zip(coords, cell, strict=True)], *inner, *values)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no parts")
    return Cube(out, list(coords), inner, values, coords)


def from_files(spark: SparkSession, path: str, pattern: str, dims: dict[str, str], inner: Sequence[str] = (), values: Sequence[str] = ("v",)) -> Cube:
    """A cube from Parquet files; the groups of ``pattern`` in a file's path are its coordinates.

    ``dims`` gives each dimension's type, in the order of the groups.
    """
    df = spark.read.parquet(path)
    name = F.col("_metadata.file_path")
    found = [F.regexp_extract(name, pattern, k + 1).cast(kind).alias(d) for k, (d, kind) in enumerate(dims.items())]
    return Cube(df.select(*found, *inner, *values), list(dims), inner, values)


def generated(spark: SparkSession, coords: dict[str, Sequence], size: int, seed: int = 0, inner: str = "i", value: str = "v") -> Cube:
    """Seeded random numbers: ``size`` of them in each cell of the product of ``coords``."""
    df = spark.range(size).select(F.col("id").cast("int").alias(inner))
    for d, labels in coords.items():
        df = df.withColumn(d, F.explode(F.array(*[F.lit(x) for x in labels])))
    mixed = F.pmod(F.xxhash64(*coords, inner, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return Cube(df.select(*coords, inner, mixed.alias(value)), list(coords), [inner], [value], coords)
