"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to a Python worker's text function at once.
SLICE = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only on one machine (tests) may the session name none: then it is a temporary
    folder.  On a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir() + "/fieldcube-shared"
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    return Scratch(df.sparkSession, label).keep(df, "rows")


class Scratch:
    """Tables in the shared folder by name; each is deleted when its readers are done."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths, self.turn = spark, f"{shared_folder(spark)}/fieldcube/{label}-{uuid.uuid4().hex}", {}, 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back, which cuts its lineage.  An older table of this name goes only then, as ``df`` may read it."""
        self.turn += 1
        path = f"{self.root}/{name}-{self.turn}"
        df.write.parquet(path)
        if name in self.paths:
            self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def append_columns(
    df: DataFrame,
    text_col: str,
    factory: Callable[[], Callable[[list], list]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with new columns computed from whole texts in Arrow batches.

    ``factory`` is called once a task; what it returns maps a list of texts (None
    for null) to one list per field.  An input column whose name clashes with a
    new one is replaced.  ``keep``: the input columns to return (default all).
    """
    new = {f.name for f in fields}
    cols = [c for c in (df.columns if keep is None else keep) if c not in new]
    name = "__text"
    while name in df.columns:
        name += "_"
    src = df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text_col}`").alias(name))
    schema = T.StructType([*src.schema.fields[:-1], *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(T.StructType(fields))
        f = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = f(part.column(part.num_columns - 1).to_pylist())
                arrays = [part.column(i) for i in range(part.num_columns - 1)]
                arrays += [pa.array(x, type=t.type) for x, t in zip(out, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*cols, *arrow.names])

    return src.mapInArrow(run, schema)


class Memo(dict):
    """A dict that computes missing values and starts anew when it is full."""

    def __init__(self, compute: Callable, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self.compute(key)
        self[key] = value
        return value


def sample_rows(df: DataFrame, id_col: str, bound: int, seed: int = 17) -> DataFrame:
    """About ``bound`` rows (all, if there are fewer), chosen by a hash of the id and so the same at any time."""
    n = df.count()
    if n <= bound:
        return df
    u = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return df.where(u < bound / n)


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, weight: str, total: int, parts: int = 1000) -> DataFrame:
    """``rows`` with ``value`` of ``table`` (unique by ``key``), null where there is none.

    ``weight`` counts the rows of each key.  Keys with at least 1/parts of all
    ``total`` rows - at most ``parts`` keys - are looked up by a broadcast, so that
    no task gets all rows of such a key; the others by a shuffle.
    """
    hot = table.where(F.col(weight) * parts >= max(1, total))
    seen = rows.join(F.broadcast(hot.select(key, value)), key, "left")
    rest = seen.where(F.col(value).isNull()).drop(value).join(table.select(key, value), key, "left")
    return seen.where(F.col(value).isNotNull()).unionByName(rest)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its own columns of these names renamed, and a function that selects all of its columns again under their names."""
    taken = {c: f"__own_{c}" for c in df.columns if c.lower() in names}
    columns = [F.col(f"`{taken.get(c, c)}`").alias(c) for c in df.columns]
    return df.withColumnsRenamed(taken), lambda out: out.select(*columns)
