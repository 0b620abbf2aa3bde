"""The cube: a tidy DataFrame whose columns are outer dimensions, inner dimensions and values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import functions as fn

#: Labels of one dimension that may be brought to the driver.
LABEL_LIMIT = 100_000
#: Elements of one array that a task may get by their key.
RUN = 100_000


class Cube:
    """Cells named by the labels of outer dimensions, each with an array along inner dimensions.

    Both kinds of dimensions are columns of ``df``, so that moving one between
    inside and outside needs no data movement.  Methods return new cubes and run
    nothing; only those that need a dimension's labels or their order and were not
    told them (``coords``) run a distinct over that one column.
    """

    _spaces: dict[str, type] = {}

    def __init__(self, df: DataFrame, dims: Sequence[str], inner: Sequence[str] = (), values: Sequence[str] = ("v",), coords: dict | None = None, scalars: dict | None = None, attrs: dict | None = None):
        missing = [c for c in [*dims, *inner, *values] if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        if coords and (unknown := set(coords) - set(dims)):
            raise ValueError(f"coordinates without a dimension: {sorted(unknown)}")
        self.df, self.dims, self.inner, self.values = df, list(dims), list(inner), list(values)
        self.coords = {d: list(x) for d, x in (coords or {}).items()}
        self.scalars, self.attrs = dict(scalars or {}), dict(attrs or {})

    def _new(self, df: DataFrame, **changes) -> Cube:
        kept = {k: changes.pop(k, getattr(self, k)) for k in ("dims", "inner", "values", "coords", "scalars", "attrs")}
        kept["coords"] = {d: x for d, x in kept["coords"].items() if d in kept["dims"]}
        return type(self)(df.select(*kept["dims"], *kept["inner"], *kept["values"]), **kept)

    def labels(self, dim: str) -> list:
        """The labels of a dimension in order: as given, else sorted."""
        if dim not in self.dims:
            raise KeyError(dim)
        if dim not in self.coords:
            got = self.df.select(dim).distinct().limit(LABEL_LIMIT + 1).collect()
            if len(got) > LABEL_LIMIT:
                raise ValueError(f"{dim} has more than {LABEL_LIMIT} labels; give coords or align by label")
            self.coords[dim] = sorted(r[0] for r in got)
        return self.coords[dim]

    def _relabelled(self, dim: str, new: Sequence, name: str) -> DataFrame:
        """``df`` with ``name``: for each label of ``dim`` the entry of ``new`` at its position."""
        table = self.df.sparkSession.createDataFrame(list(zip(self.labels(dim), new, strict=True)), ["__label", "__new"])
        out = self.df.join(F.broadcast(table), F.col(dim) == F.col("__label"))  # bounded by LABEL_LIMIT
        return out.drop("__label", *([name] if name in out.columns else [])).withColumnRenamed("__new", name)

    def _per_cell(self, dims: Sequence[str], entries: Sequence | Cube, name: str) -> DataFrame:
        """``df`` with ``name``: the entry of each cell of ``dims``; ``entries`` is nested as their labels are, or a cube over ``dims``."""
        if isinstance(entries, Cube):
            return self._joined_cells(dims, entries, name)
        flat = [entries]
        for d in dims:
            if any(len(x) != len(self.labels(d)) for x in flat):
                raise ValueError(f"the entries do not match the {len(self.labels(d))} labels of {d}")
            flat = [y for x in flat for y in x]
        if len(flat) > LABEL_LIMIT:
            raise ValueError(f"more than {LABEL_LIMIT} cells; give a cube of them where the method takes one")
        rows = [(*cell, e) for cell, e in zip(product(*(self.labels(d) for d in dims)), flat, strict=True)]
        table = self.df.sparkSession.createDataFrame(rows, [*(f"__{d}" for d in dims), name])
        on = [F.col(d) == F.col(f"__{d}") for d in dims]
        return self.df.join(F.broadcast(table), on).drop(*(f"__{d}" for d in dims))  # bounded by LABEL_LIMIT

    def _joined_cells(self, dims: Sequence[str], entries: Cube, name: str) -> DataFrame:
        """``df`` with ``name``: the one value that ``entries`` has at each cell's labels, null ones included."""
        if set(entries.dims) != set(dims) or entries.inner or len(entries.values) != 1:
            raise ValueError(f"the entries need one value for each cell of {list(dims)}")
        keys = [f"__{d}" for d in dims]
        table = entries.df.select(*[F.col(d).alias(k) for d, k in zip(dims, keys, strict=True)], F.col(entries.values[0]).alias(name), F.lit(True).alias("__found"))
        if not table.groupBy(*keys).count().where(F.col("count") > 1).isEmpty():
            raise ValueError(f"a cell of {list(dims)} has several entries")
        df = self.df.join(table, [F.col(d).eqNullSafe(F.col(k)) for d, k in zip(dims, keys, strict=True)], "left")
        absent = F.raise_error(F.concat_ws(" ", F.lit("no entry for the cell"), *[F.coalesce(F.col(d).cast("string"), F.lit("null")) for d in dims]))
        return df.withColumn(name, F.when(F.col("__found"), F.col(name)).otherwise(absent)).drop(*keys, "__found")

    # Namespaces

    @classmethod
    def register(cls, name: str, space: type) -> None:
        """``cube.<name>.<method>()`` calls a method of ``space``, a subclass of Cube, on the cube."""
        if not (isinstance(space, type) and issubclass(space, Cube)):
            raise TypeError(f"{space} is not a subclass of Cube")
        if name in Cube._spaces or hasattr(Cube, name):
            raise ValueError(f"{name} is taken")
        Cube._spaces[name] = space

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in Cube._spaces:
            raise AttributeError(name)
        return Cube._spaces[name](self.df, self.dims, self.inner, self.values, self.coords, self.scalars, self.attrs)

    # Selection

    def select(self, criteria: dict | None = None, drop: bool = False, **more) -> Cube:
        """Cells by label: one label drops the dimension (kept as a scalar unless ``drop``), a list keeps it in that order.

        A label that no cell has is a KeyError.  Where the labels are not known, a
        query for the wanted ones alone finds out.
        """
        df, dims, coords, scalars = self.df, list(self.dims), dict(self.coords), dict(self.scalars)
        for dim, want in {**(criteria or {}), **more}.items():
            if dim not in dims:
                if scalars.get(dim) == want and dim in scalars:
                    continue
                raise KeyError(f"{dim} is no dimension")
            some = list(want) if isinstance(want, (list, tuple, range)) else [want]
            held = coords[dim] if dim in coords else [r[0] for r in df.where(F.col(dim).isin(some)).select(dim).distinct().collect()]
            if unknown := [x for x in some if x not in held]:
                raise KeyError(f"{dim} has no {unknown}")
            df = df.where(F.col(dim).isin(some))
            if isinstance(want, (list, tuple, range)):
                coords[dim] = some
            else:
                dims.remove(dim)
                if not drop:
                    scalars[dim] = want
        return self._new(df, dims=dims, coords=coords, scalars=scalars)

    def iselect(self, criteria: dict | None = None, drop: bool = False, **more) -> Cube:
        """Cells by position; negative ones count from the end."""
        want = {**(criteria or {}), **more}
        at = {d: [self.labels(d)[k] for k in x] if isinstance(x, (list, tuple, range)) else self.labels(d)[x] for d, x in want.items()}
        return self.select(at, drop)

    def take(self, dim: str, indices: Any, method: str = "isel", drop: bool = True) -> Cube:
        """Elements of the inner arrays: one drops the inner dimension, a list keeps it.

        ``isel``: by index; a list numbers them anew in the order given.  ``sel``: by
        the inner dimension's own labels, which stay; one that no cell has is a
        KeyError.  ``drop=False`` keeps a single one as a scalar.
        """
        if dim not in self.inner:
            raise ValueError(f"{dim} is no inner dimension")
        if method not in ("isel", "sel"):
            raise ValueError(f"unknown method {method!r}")
        if method == "sel":
            many = isinstance(indices, (list, tuple, range))
            some = list(indices) if many else [indices]
            df = self.df.where(F.col(dim).isin(some))
            held = [r[0] for r in df.select(dim).distinct().collect()]
            if unknown := [x for x in some if x not in held]:
                raise KeyError(f"{dim} has no {unknown}")
            if many:
                return self._new(df)
            return self._new(df, inner=[x for x in self.inner if x != dim], scalars={**self.scalars, **({} if drop else {dim: indices})})
        if isinstance(indices, int):
            return self._new(self.df.where(F.col(dim) == indices), inner=[x for x in self.inner if x != dim], scalars={**self.scalars, **({} if drop else {dim: indices})})
        at = F.array_position(F.array(*[F.lit(k).cast(self.df.schema[dim].dataType) for k in indices]), F.col(dim))
        df = self.df.where(F.col(dim).isin(list(indices))).withColumn(dim, (at - 1).cast(self.df.schema[dim].dataType))
        return self._new(df)

    def mask(self, other: Cube, compare: str, threshold: float, replacement: float = 0.0) -> Cube:
        """Values replaced where ``other`` (by label) compares true with the threshold."""
        test = fn.comparison(compare)
        return self._paired(other, lambda a, b: F.when(test(b, F.lit(threshold)), F.lit(replacement)).otherwise(a), "label")

    def set_metadata(self, column: str, entries: dict | None = None, **more) -> Cube:
        """Entries of the string map ``column`` set or replaced; a null map, or a cube without that column, begins empty.

        A value may be a Column; None takes the entry away.  The map is one of the
        cube's value columns from then on.
        """
        want = {**(entries or {}), **more}
        empty = F.create_map().cast("map<string,string>")
        old = F.coalesce(F.col(column), empty) if column in self.df.columns else empty
        kept = F.map_filter(old, lambda k, _: ~k.isin([str(k) for k in want])) if want else old
        new = [y for k, v in want.items() if v is not None for y in (F.lit(str(k)), (v if isinstance(v, Column) else F.lit(str(v))).cast("string"))]
        df = self.df.withColumn(column, F.map_concat(kept, F.create_map(*new)) if new else kept)
        return self._new(df, values=[*self.values, *([] if column in self.values else [column])])

    # Shape

    def map(self, function: Callable[[Column], Column]) -> Cube:
        """A Column expression on each value."""
        return self._new(self.df.withColumns({v: function(F.col(v)) for v in self.values}))

    def map_each(self, function: Callable[[Column, Column], Column], dim: str | Sequence[str], params: Sequence | Cube) -> Cube:
        """A Column expression of the value and of one parameter for each label of ``dim``, or for each cell of several (``params`` nested as they are).

        ``params`` may be a cube of one value over these dimensions, with any number
        of cells: it is joined by label and never comes to the driver.  Two parameters
        for a cell are an error, which a query over the parameters finds out; a cell
        without one is an error when the result is computed.
        """
        df = self._per_cell([dim] if isinstance(dim, str) else dim, params, "__param")
        return self._new(df.withColumns({v: function(F.col(v), F.col("__param")) for v in self.values}))

    def map_cells(self, functions: Sequence, dims: str | Sequence[str]) -> Cube:
        """A Column expression of its own for each cell of ``dims``; ``functions`` is nested as their labels are."""
        dims = [dims] if isinstance(dims, str) else list(dims)
        known: dict[Callable, int] = {}

        def numbered(x: Any) -> Any:
            return known.setdefault(x, len(known)) if callable(x) else [numbered(y) for y in x]

        df = self._per_cell(dims, numbered(functions), "__function")

        def chosen(v: Column) -> Column:
            out = F.lit(None)
            for f, k in known.items():
                out = F.when(F.col("__function") == k, f(v)).otherwise(out)
            return out

        return self._new(df.withColumns({v: chosen(F.col(v)) for v in self.values}))

    def map_arrays(self, function: Callable[[np.ndarray], np.ndarray]) -> Cube:
        """A Python function on each cell's array along its only inner dimension; a cell must fit in memory."""
        (inner,), (value,), dims = self.inner, self.values, self.dims
        schema = ", ".join(f"`{c}` {self.df.schema[c].dataType.simpleString()}" for c in [*dims, inner]) + f", `{value}` double"

        def run(cell: pd.DataFrame) -> pd.DataFrame:
            out = np.asarray(function(cell.sort_values(inner)[value].to_numpy()), float)
            return pd.DataFrame({**{d: [cell[d].iloc[0]] * len(out) for d in dims}, inner: range(len(out)), value: out})

        return self._new(self.df.groupBy(*dims).applyInPandas(run, schema))

    def yields(self, functions: Sequence[Callable[[Column], Column]], dim: str, labels: Sequence) -> Cube:
        """Several results for each value, along a new outer dimension."""
        if len(functions) != len(labels):
            raise ValueError(f"{len(functions)} results for {len(labels)} labels")
        (value,) = self.values
        rows = F.array(*[F.struct(F.lit(x).alias(dim), f(F.col(value)).alias(value)) for f, x in zip(functions, labels, strict=True)])
        df = self.df.withColumn("__y", F.explode(rows)).drop(value).select("*", f"__y.{dim}", f"__y.{value}")
        return self._new(df, dims=[*self.dims, dim], coords={**self.coords, dim: list(labels)})

    def yields_arrays(self, function: Callable[[np.ndarray], Any], dim: str, labels: Sequence) -> Cube:
        """The arrays that a Python function (or generator) gives for each cell's array, along a new outer dimension.

        A cell must fit in memory.  Another number of arrays than labels is an error.
        """
        (inner,), (value,), dims, count = self.inner, self.values, self.dims, len(labels)
        schema = ", ".join(f"`{c}` {self.df.schema[c].dataType.simpleString()}" for c in [*dims, inner]) + f", `{value}` double, __result int"

        def run(cell: pd.DataFrame) -> pd.DataFrame:
            outs = [np.asarray(x, float) for x in function(cell.sort_values(inner)[value].to_numpy())]
            if len(outs) != count:
                raise ValueError(f"{len(outs)} results for {count} labels")
            frames = [pd.DataFrame({**{d: [cell[d].iloc[0]] * len(x) for d in dims}, inner: range(len(x)), value: x, "__result": k}) for k, x in enumerate(outs)]
            return pd.concat(frames)

        return self._results(self.df.groupBy(*dims).applyInPandas(run, schema), dims, dim, labels)

    def _results(self, df: DataFrame, dims: Sequence[str], dim: str, labels: Sequence) -> Cube:
        """Rows numbered by ``__result``, under the labels of the new dimension ``dim``."""
        df = df.withColumn(dim, F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("__result") + 1))
        return self._new(df, dims=[*dims, dim], coords={**self.coords, dim: list(labels)})

    def expand(self, dim: str, inner: str, size: int | None = None, labels: Sequence | None = None) -> Cube:
        """An inner dimension becomes an outer one: its first ``size`` elements, named by ``labels`` if given.

        More elements than any cell has is an error; a query that stops at the first
        row with the last of them finds out.
        """
        if inner not in self.inner:
            raise ValueError(f"{inner} is no inner dimension")
        if size is None and labels is None:
            raise TypeError("size or labels is needed")
        if size is not None and labels is not None and size != len(labels):
            raise ValueError(f"{len(labels)} labels for {size} elements")
        size = len(labels) if size is None else size
        if size > 0 and self.df.where(F.col(inner) == size - 1).isEmpty():
            raise ValueError(f"{inner} has fewer than {size} elements")
        df = self.df.where(F.col(inner) < size)
        label = F.col(inner) if labels is None else F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col(inner) + 1).cast("int"))
        df = df.withColumn("__label", label).drop(inner).withColumnRenamed("__label", dim)
        return self._new(df, dims=[*self.dims, dim], inner=[x for x in self.inner if x != inner], coords={**self.coords, dim: list(labels or range(size))})

    def stack(self, dim: str, inner: str | None = None) -> Cube:
        """An outer dimension becomes the first inner one, numbered by its order."""
        inner = inner or dim
        df = self._relabelled(dim, range(len(self.labels(dim))), inner).withColumn(inner, F.col(inner).cast("int"))
        return self._new(df, dims=[d for d in self.dims if d != dim], inner=[inner, *self.inner])

    def flatten(self, dim: str = "", inner: str | None = None) -> Cube:
        return self.stack(dim or self.dims[0], inner)

    def concatenate(self, dim: str, inner: str | None = None) -> Cube:
        """The arrays along ``dim`` follow each other in one inner dimension."""
        inner = inner or self.inner[0]
        rest = [d for d in self.dims if d != dim]
        placed = self._relabelled(dim, range(len(self.labels(dim))), "__at")
        sizes = placed.groupBy(*rest, "__at").agg((F.max(inner) + 1).alias("__size"))
        from pyspark.sql import Window

        before = Window.partitionBy(*rest).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
        # A cell's array may be long: its elements meet their offset in runs of bounded length, not in one task.
        runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__size") - 1) / RUN))
        offsets = offsets.withColumn("__run", F.explode(runs)).drop("__size")
        placed = placed.withColumn("__run", F.floor(F.col(inner) / RUN))
        df = placed.join(offsets, [*rest, "__at", "__run"]).withColumn(inner, (F.col("__before") + F.col(inner)).cast("long"))
        return self._new(df, dims=rest)

    def broadcast(self, other: Cube, exclude: Sequence[str] = ()) -> Cube:
        """Each cell once for every label of the dimensions that only ``other`` has; shared ones must have equal labels."""
        df, dims, coords = self.df, list(self.dims), dict(self.coords)
        for d in other.dims:
            if d in exclude:
                continue
            if d in self.dims:
                if self.labels(d) != other.labels(d):
                    raise ValueError(f"labels of {d} differ")
            else:
                df = df.withColumn(d, F.explode(F.array(*[F.lit(x) for x in other.labels(d)])))
                dims, coords[d] = [d, *dims], other.labels(d)
        return self._new(df, dims=dims, coords=coords)

    def join(self, other: Cube, dim: str, labels: Sequence | None = None, match_coord_values: bool = False) -> Cube:
        """The cells of both along ``dim``, an existing or a new dimension (then ``labels`` are the two labels, 0 and 1 if not given).

        All other labels must be equal, or with ``match_coord_values`` are taken
        from this cube by position.
        """
        right = other
        if match_coord_values:
            for d in self.dims:
                if d != dim and right.labels(d) != self.labels(d):
                    right = right._new(right._relabelled(d, self.labels(d), d), coords={**right.coords, d: self.labels(d)})
        for d in self.dims:
            if d != dim and self.labels(d) != right.labels(d):
                raise ValueError(f"labels of {d} differ")
        if dim in self.dims:
            return self._new(self.df.unionByName(right.df), coords={**self.coords, dim: [*self.labels(dim), *right.labels(dim)]})
        a, b = labels or (0, 1)
        df = self.df.withColumn(dim, F.lit(a)).unionByName(right.df.withColumn(dim, F.lit(b)))
        return self._new(df, dims=[dim, *self.dims], coords={**self.coords, dim: [a, b]})

    def transform(self, function: Callable, params: Sequence, dim: str, labels: Sequence | None = None) -> Cube:
        """``function(cube, param)`` for each parameter, joined along ``dim``; one parameter makes ``dim`` a scalar."""
        if not params:
            raise ValueError("no parameters")
        labels = list(labels or params)
        parts = [function(self, p) for p in params]
        if len(parts) == 1:
            return parts[0]._new(parts[0].df, scalars={**parts[0].scalars, dim: labels[0]})
        df = parts[0].df.withColumn(dim, F.lit(labels[0]))
        for part, x in zip(parts[1:], labels[1:], strict=True):
            df = df.unionByName(part.df.withColumn(dim, F.lit(x)))
        return parts[0]._new(df, dims=[dim, *parts[0].dims], coords={**parts[0].coords, dim: labels})

    def transform_values(self, function: Callable[[Column, Column], Column], params: Sequence, dim: str) -> Cube:
        """``transform`` for a Column expression of value and parameter: one pass over the data."""
        df = self.df.withColumn(dim, F.explode(F.array(*[F.lit(p) for p in params])))
        df = df.withColumns({v: function(F.col(v), F.col(dim)) for v in self.values})
        return self._new(df, dims=[dim, *self.dims], coords={**self.coords, dim: list(params)})

    def set_attributes(self, **attrs) -> Cube:
        return self._new(self.df, attrs={**self.attrs, **attrs})

    # Reductions

    def reduce(self, how: str | Callable[[Column], Column], dim: str = "", keep_dim: bool = False, batch_size: int = 0) -> Cube:
        """One value from those along an outer dimension (the first by default), for each inner element.

        ``batch_size``: allowed for functions that may be composed of batches; the
        result is the same, as Spark combines partial results anyway.  ``keep_dim``
        keeps the dimension with the label "first-last".
        """
        dim = dim or self.dims[0]
        if dim not in self.dims:
            raise KeyError(dim)
        if batch_size > 1 and (callable(how) or how not in fn.BATCHABLE):
            raise ValueError(f"{how} can't be reduced in batches")
        f = how if callable(how) else fn.reduction(how)
        rest = [d for d in self.dims if d != dim]
        df = self.df.groupBy(*rest, *self.inner).agg(*[f(F.col(v)).alias(v) for v in self.values])
        if not keep_dim:
            return self._new(df, dims=rest)
        name = f"{self.labels(dim)[0]}-{self.labels(dim)[-1]}"
        return self._new(df.withColumn(dim, F.lit(name)), coords={**self.coords, dim: [name]})

    def reduce_yields(self, functions: Sequence[str | Callable[[Column], Column]], name: str, labels: Sequence, dim: str = "") -> Cube:
        """Several reductions of an outer dimension in one pass, along the new outer dimension ``name``."""
        if len(functions) != len(labels):
            raise ValueError(f"{len(functions)} results for {len(labels)} labels")
        dim = dim or self.dims[0]
        if dim not in self.dims:
            raise KeyError(dim)
        (value,), rest = self.values, [d for d in self.dims if d != dim]
        results = [(f if callable(f) else fn.reduction(f))(F.col(value)).alias(f"__{k}") for k, f in enumerate(functions)]
        df = self.df.groupBy(*rest, *self.inner).agg(*results)
        df = df.select(*rest, *self.inner, F.posexplode(F.array(*[F.col(f"__{k}") for k in range(len(results))])).alias("__result", value))
        return self._results(df, rest, name, labels)

    def sum(self, dim: str = "", **options) -> Cube:
        return self.reduce("sum", dim, **options)

    def mean(self, dim: str = "", **options) -> Cube:
        return self.reduce("mean", dim, **options)

    def std(self, dim: str = "", **options) -> Cube:
        return self.reduce("std", dim, **options)

    def var(self, dim: str = "", **options) -> Cube:
        return self.reduce("var", dim, **options)

    def min(self, dim: str = "", **options) -> Cube:
        return self.reduce("min", dim, **options)

    def max(self, dim: str = "", **options) -> Cube:
        return self.reduce("max", dim, **options)

    def prod(self, dim: str = "", **options) -> Cube:
        return self.reduce("prod", dim, **options)

    def norm(self, dim: str = "", **options) -> Cube:
        return self.reduce("norm", dim, **options)

    def quantile(self, q: float, dim: str = "", accuracy: int | None = None, **options) -> Cube:
        """The linearly interpolated quantile, or with ``accuracy`` an approximate one in bounded memory."""
        return self.reduce((lambda v: F.percentile(v, q)) if accuracy is None else (lambda v: F.percentile_approx(v, q, accuracy)), dim, **options)

    def reduce_inner(self, how: str, inner: Sequence[str] | str | None = None) -> Cube:
        """One value from those inside each cell, along some inner dimensions (all by default)."""
        gone = set([inner] if isinstance(inner, str) else self.inner if inner is None else inner)
        rest = [x for x in self.inner if x not in gone]
        df = self.df.groupBy(*self.dims, *rest).agg(*[fn.reduction(how)(F.col(v)).alias(v) for v in self.values])
        return self._new(df, inner=rest)

    def reduce_arrays(self, function: Callable[[np.ndarray], Any], dim: str = "", block: int = 4096, yields: tuple[str, Sequence] | None = None) -> Cube:
        """A Python function of (labels, elements) arrays to one row of elements, on blocks of the only inner dimension.

        It must treat elements apart from each other; a task holds one block of all
        labels, so memory does not grow with the cells' size.  ``yields``: (new outer
        dimension, its labels), if the function gives a row for each of several results.
        """
        dim = dim or self.dims[0]
        (inner,), (value,), rest = self.inner, self.values, [d for d in self.dims if d != dim]
        schema = ", ".join(f"`{c}` {self.df.schema[c].dataType.simpleString()}" for c in [*rest, inner]) + f", `{value}` double, __result int"
        count = len(yields[1]) if yields else 1

        def run(part: pd.DataFrame) -> pd.DataFrame:
            table = part.pivot(index=dim, columns=inner, values=value).sort_index()
            outs = list(function(table.to_numpy())) if yields else [function(table.to_numpy())]
            if len(outs) != count:
                raise ValueError(f"{len(outs)} results for {count} labels")
            frames = [pd.DataFrame({**{d: [part[d].iloc[0]] * len(table.columns) for d in rest}, inner: table.columns, value: np.asarray(x, float), "__result": k}) for k, x in enumerate(outs)]
            return pd.concat(frames)

        df = self.df.withColumn("__block", F.floor(F.col(inner) / block)).groupBy(*rest, "__block").applyInPandas(run, schema)
        return self._results(df, rest, *yields) if yields else self._new(df, dims=rest)

    def group(self, dim: str, by: Callable[[Column], Column], how: str, name: str | None = None) -> Cube:
        """Reduce along ``dim`` within groups of labels given by an expression of the label."""
        name = name or dim
        rest = [d for d in self.dims if d != dim]
        df = self.df.withColumn("__g", by(F.col(dim))).groupBy(*rest, "__g", *self.inner)
        df = df.agg(*[fn.reduction(how)(F.col(v)).alias(v) for v in self.values]).withColumnRenamed("__g", name)
        return self._new(df, dims=[*rest, name], coords={d: x for d, x in self.coords.items() if d in rest})

    # Arithmetic

    def _paired(self, other: Cube, f: Callable[[Column, Column], Column], align: str) -> Cube:
        if set(self.dims) != set(other.dims) or set(self.inner) != set(other.inner) or self.values != other.values:
            raise ValueError("the cubes have different dimensions or values")
        right = other
        if align == "position":
            for d in self.dims:
                a, b = self.labels(d), other.labels(d)
                if len(a) != len(b):
                    raise ValueError(f"{d} has {len(a)} and {len(b)} labels")
                if a != b:
                    right = right._new(right._relabelled(d, a, d), coords={**right.coords, d: a})
        renamed = right.df.withColumnsRenamed({v: f"__r_{v}" for v in self.values})
        df = self.df.join(renamed, [*self.dims, *self.inner])
        return self._new(df.withColumns({v: f(F.col(v), F.col(f"__r_{v}")) for v in self.values}))

    def combine(self, other: Cube | float, how: str, align: str = "position") -> Cube:
        """Arithmetic with a number, or with a cube whose cells match by position or by label."""
        f = fn.BINARY[how]
        if isinstance(other, Cube):
            return self._paired(other, f, align)
        return self.map(lambda v: f(v, F.lit(float(other))))

    def add(self, other: Any, align: str = "position") -> Cube:
        return self.combine(other, "add", align)

    def subtract(self, other: Any, align: str = "position") -> Cube:
        return self.combine(other, "subtract", align)

    def multiply(self, other: Any, align: str = "position") -> Cube:
        return self.combine(other, "multiply", align)

    def divide(self, other: Any, align: str = "position") -> Cube:
        return self.combine(other, "divide", align)

    def power(self, other: Any, align: str = "position") -> Cube:
        return self.combine(other, "power", align)

    # Results

    def packed(self) -> DataFrame:
        """One array a cell, in the order of the inner dimensions; a cell must fit in memory."""
        (value,) = self.values
        items = F.array_sort(F.collect_list(F.struct(*self.inner, value)))
        return self.df.groupBy(*self.dims).agg(F.transform(items, lambda x: x[value]).alias(value))

    def write(self, path: str, by: Sequence[str] = (), kind: str = "parquet") -> None:
        """Files of any format that Spark writes, in one folder for each label of the dimensions ``by``."""
        self.df.write.format(kind).partitionBy(*by).save(path)
