"""Plans of known shape and any size, for tests and trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import DEFAULT_OUTPUT, Plan

# The names of nodes, inputs and outputs below.


def _name(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _edges(df: DataFrame, src: Column, dst: Column, input: Column | str = "input", output: str | Column = DEFAULT_OUTPUT) -> DataFrame:
    return df.select(src.alias("src"), _name(output).alias("output"), dst.alias("dst"), _name(input).alias("input"))


def _plan(*parts: DataFrame) -> Plan:
    edges = reduce(DataFrame.unionByName, parts)
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    return Plan(names.withColumn("payload", F.lit(None).cast("string")), edges)


def empty(spark: SparkSession) -> Plan:
    return _plan(spark.createDataFrame([], "src string, output string, dst string, input string"))


def linear(spark: SparkSession, nproc: int = 5) -> Plan:
    """reader, process-0, process-1, ..., writer in one chain."""
    k = F.col("id")
    src = F.when(k == 0, "reader").otherwise(_name("process-", k - 1))
    return _plan(_edges(spark.range(nproc + 1), src, F.when(k == nproc, "writer").otherwise(_name("process-", k))))


def disconnected(spark: SparkSession, nchains: int = 5, nproc: int = 1) -> Plan:
    """Chains i: reader-i, process-i.0, process-i.1, ..., writer-i; with one process a chain just process-i."""
    k, i = F.col("k"), F.col("id")

    def process(at: Column) -> Column:
        return _name("process-", i) if nproc == 1 else _name("process-", i, ".", at)

    rows = spark.range(nchains).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(nproc))))
    return _plan(_edges(rows, F.when(k == 0, _name("reader-", i)).otherwise(process(k - 1)), F.when(k == nproc, _name("writer-", i)).otherwise(process(k))))


def simple(spark: SparkSession, nread: int = 5, nproc: int = 3) -> Plan:
    """Every process-i reads every reader-j as input j, and writer-i reads process-i."""
    i, j = F.col("id"), F.col("j")
    rows = spark.range(nproc).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nread - 1))))
    return _plan(_edges(rows, _name("reader-", j), _name("process-", i), _name("input", j)), _edges(spark.range(nproc), _name("process-", i), _name("writer-", i)))


def multi(spark: SparkSession, nread: int = 5, nout1: int = 3, nout2: int = 2) -> Plan:
    """Nodes of several outputs.

    process-0 reads all readers and has ``nout1`` outputs; process-i between reads
    output0 and output i+1 of it; the last process reads output1 and the third reader
    (or the last) and has ``nout2`` outputs; each output of it meets each process
    between in a writer.
    """
    if nout1 < 3:
        raise ValueError("nout1 is 3 at least")
    k, last, between = F.col("id"), nout1 - 1, nout1 - 2
    first, end = F.lit("process-0"), F.lit(f"process-{last}")
    middle = spark.range(1, last)
    writers = spark.range(nout2 * between)
    return _plan(
        _edges(spark.range(nread), _name("reader-", k), first, _name("input", k)),
        _edges(middle, first, _name("process-", k), "input1", "output0"),
        _edges(middle, first, _name("process-", k), "input2", _name("output", k + 1)),
        _edges(spark.range(1), first, end, "input1", "output1"),
        _edges(spark.range(1), F.lit(f"reader-{min(2, nread - 1)}"), end, "input2"),
        _edges(writers, _name("process-", 1 + k % between), _name("writer-", k), "input1"),
        _edges(writers, end, _name("writer-", k), "input2", _name("output", F.floor(k / between))),
    )


def comb(spark: SparkSession, nteeth: int = 5, nproc: int = 0) -> Plan:
    """Teeth i: reader-i, process-i.0, ..., whose ends join one after the other in join-0, join-1, ..., then writer."""
    i, j = F.col("id"), F.col("j")

    def tooth(at: Column, level: Column) -> Column:
        return F.when(level < 0, _name("reader-", at)).otherwise(_name("process-", at, ".", level))

    rows = spark.range(nteeth).withColumn("j", F.explode(F.filter(F.sequence(F.lit(-1), F.lit(nproc)), lambda x: x < nproc)))
    joins = spark.range(nteeth - 1)
    top = F.lit(nproc - 1)
    return _plan(
        _edges(rows.where(j >= 0), tooth(i, j - 1), tooth(i, j)),
        _edges(joins, F.when(i == 0, tooth(i, top)).otherwise(_name("join-", i - 1)), _name("join-", i), "input1"),
        _edges(joins, tooth(i + 1, top), _name("join-", i), "input2"),
        _edges(spark.range(1), F.lit(f"join-{nteeth - 2}") if nteeth > 1 else tooth(i, top), F.lit("writer")),
    )
