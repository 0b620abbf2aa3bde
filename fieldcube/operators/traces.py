"""Trace logs of a job: parsing, durations of tasks and transfers, and which pages to free."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Actions of a task, and the pairs (name, later, earlier) of its durations.
TASK_ACTIONS = ["planned", "enqueued", "started", "loaded", "computed", "published", "completed"]
TASK_DURATIONS = [
    ("total_e2e", "completed", "planned"),
    ("total_worker", "published", "enqueued"),
    ("comm2worker", "enqueued", "planned"),
    ("task_procstart", "started", "enqueued"),
    ("task_load", "loaded", "started"),
    ("task_callablerun", "computed", "loaded"),
    ("task_publish", "published", "computed"),
    ("comm2ctrl", "completed", "published"),
]
#: The same of a transfer.
TRANSMIT_ACTIONS = ["planned", "started", "loaded", "received", "unloaded", "completed"]
TRANSMIT_DURATIONS = [
    ("total", "completed", "planned"),
    ("comm2source", "started", "planned"),
    ("loadDelay", "loaded", "started"),
    ("comm2target", "received", "loaded"),
    ("unloadDelay", "unloaded", "received"),
    ("comm2ctrl", "completed", "unloaded"),
]


def marks(lines: DataFrame, logger: str, begin: str = "#") -> DataFrame:
    """(kind, action, task, worker, dataset, source, target, mode, at) of the lines that hold ``logger``.

    A line's text after the first ``begin`` is "key=value;..."; its action is "kind_action".
    """
    data = F.expr(f"str_to_map(trim(substr(value, instr(value, '{begin}') + 1)), ';', '=')")
    rows = lines.where(F.contains("value", F.lit(logger)) & F.contains("value", F.lit(begin))).select(data.alias("m"))
    action = F.split(F.col("m")["action"], "_", 2)
    fields = [F.try_element_at("m", F.lit(k)).alias(k) for k in ("task", "worker", "dataset", "source", "target", "mode")]
    return rows.select(F.get(action, F.lit(0)).alias("kind"), F.get(action, F.lit(1)).alias("action"), *fields, F.try_element_at("m", F.lit("at")).cast("long").alias("at"))


def microtraces(lines: DataFrame, logger: str, begin: str = "#") -> DataFrame:
    """(kind, duration_ns) of the lines that hold ``logger``: "kind=nanoseconds" after ``begin``."""
    data = F.expr(f"trim(substr(value, instr(value, '{begin}') + 1))")
    rows = lines.where(F.contains("value", F.lit(logger)) & F.contains("value", F.lit(begin)))
    return rows.select(F.substring_index(data, "=", 1).alias("kind"), F.substring_index(data, "=", -1).cast("long").alias("duration_ns"))


def microtrace_stats(traces: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Sum, count and mean by kind; with ``kinds`` those without a trace too (count 0, mean null)."""
    out = traces.groupBy("kind").agg(F.sum("duration_ns").alias("duration_ns_sum"), F.count("*").alias("duration_ns_cnt"), F.avg("duration_ns").alias("duration_ns_avg"))
    if kinds is None:
        return out
    all_ = traces.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return all_.join(out, "kind", "left").na.fill(0, ["duration_ns_sum", "duration_ns_cnt"])


def _durations(rows: DataFrame, keys: Sequence[str], actions: Sequence[str], pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One conditional aggregate an action (the earliest, should there be several), then differences."""
    wide = rows.groupBy(*keys).agg(*[F.min(F.when(F.col("action") == a, F.col("at"))).alias(a) for a in actions])
    return wide.select("*", *[(F.col(b) - F.col(a)).alias(name) for name, b, a in pairs])


def task_durations(rows: DataFrame, actions: Sequence[str] = TASK_ACTIONS, pairs: Sequence[tuple[str, str, str]] = TASK_DURATIONS) -> DataFrame:
    """Times of each action by task and worker, and the durations between them."""
    return _durations(rows, ["task", "worker"], actions, pairs)


def filled(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str = "at") -> DataFrame:
    """Each of ``columns`` replaced by its latest value within the keys that is not null.

    One aggregate with partial results, joined back: a key of many rows is not one task.
    """
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in columns]
    found = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*last)
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.drop(*columns).join(found, on, "left").select(*rows.columns)


def transmit_durations(rows: DataFrame) -> DataFrame:
    """Times and durations of each transfer; mode and source come from the marks that have them."""
    rows = filled(rows, ["mode", "source"], ["dataset", "target"])
    return _durations(rows, ["dataset", "target", "source", "mode"], TRANSMIT_ACTIONS, TRANSMIT_DURATIONS)


def summary(durations: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sum, mean and maximum of each duration."""
    return durations.groupBy(*keys).agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("sum", F.sum), ("mean", F.avg), ("max", F.max))])


def page_out(pages: DataFrame, amount: int, keys: Sequence[str] = ()) -> DataFrame:
    """The pages (key, created, retrieved_first, retrieved_last, size) to free until ``amount`` bytes are.

    Pages read once go first, the oldest first; then those read more often, by their
    last reading; then those never read, the newest first.  ``keys``: apart in each group.
    """
    once = F.col("retrieved_first") == F.col("retrieved_last")
    rank = F.when(F.col("retrieved_first").isNull(), 2).when(once, 0).otherwise(1)
    within = F.when(rank == 0, F.col("created")).when(rank == 1, F.col("retrieved_last")).otherwise(-F.col("created"))
    rows = pages.withColumn("class", rank).withColumn("__within", within)
    before = Window.partitionBy(*keys).orderBy("class", "__within", "key").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("freed_before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("freed_before") < amount).drop("__within")
