"""Jobs of named steps, each a function of DataFrames, checked before anything runs."""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Step:
    """A function, its parameters' types, and the parameters given already."""

    function: Callable
    params: dict[str, Any]
    defaults: frozenset[str]
    result: Any
    values: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def of(function: Callable) -> Step:
        hints = get_type_hints(function)
        found = inspect.signature(function).parameters
        return Step(function, {n: hints.get(n, Any) for n in found}, frozenset(n for n, p in found.items() if p.default is not p.empty), hints.get("return", Any))

    def with_values(self, *args, **kwargs) -> Step:
        return replace(self, values={**self.values, **dict(zip(self.params, args, strict=False)), **kwargs})


@dataclass
class Job:
    steps: dict[str, Step]
    edges: list[tuple[str, str, str]]

    def sinks(self) -> list[str]:
        read = {a for a, _, _ in self.edges}
        return [n for n in self.steps if n not in read]

    def run(self, outputs: list[str] | None = None) -> dict[str, Any]:
        """Results of the steps named (the sinks by default).

        Steps only build DataFrames, so this is lazy; frames that several steps
        read are kept by Spark's own cache if the caller persists them.
        """
        done: dict[str, Any] = {}
        todo = list(outputs or self.sinks())
        while todo:
            name = todo[-1]
            into = {param: src for src, dst, param in self.edges if dst == name}
            if open_ := [src for src in into.values() if src not in done]:
                todo += open_
                continue
            if name not in done:
                step = self.steps[name]
                done[name] = step.function(**step.values, **{p: done[src] for p, src in into.items()})
            todo.pop()
        return {n: done[n] for n in outputs or self.sinks()}


def _fits(have: Any, want: Any) -> bool:
    if Any in (have, want):
        return True
    return issubclass(have, want) if isinstance(have, type) and isinstance(want, type) else have == want


class JobBuilder:
    def __init__(self, steps: dict[str, Step] | None = None, edges: tuple = ()):
        self.steps, self.edges = dict(steps or {}), tuple(edges)

    def with_step(self, name: str, step: Step | Callable) -> JobBuilder:
        return JobBuilder({**self.steps, name: step if isinstance(step, Step) else Step.of(step)}, self.edges)

    def with_edge(self, source: str, target: str, into: str) -> JobBuilder:
        return JobBuilder(self.steps, (*self.edges, (source, target, into)))

    def build(self) -> tuple[Job | None, list[str]]:
        """The job and no errors, or None and all that is wrong."""
        errors = []
        for name, step in self.steps.items():
            for p, v in step.values.items():
                if p not in step.params:
                    errors.append(f"{name} has no parameter {p}")
                elif isinstance(want := step.params[p], type) and not isinstance(v, want):
                    errors.append(f"{name} needs {want.__name__} for {p}, got {type(v).__name__}")
        for a, b, p in self.edges:
            if a not in self.steps or b not in self.steps:
                errors.append(f"no such step: {a if a not in self.steps else b}")
            elif p not in self.steps[b].params:
                errors.append(f"{b} has no parameter {p}")
            elif not _fits(self.steps[a].result, self.steps[b].params[p]):
                errors.append(f"{a} does not give what {b} needs for {p}")
        for name, step in self.steps.items():
            given = set(step.values) | step.defaults | {p for _, b, p in self.edges if b == name}
            errors += [f"{name} lacks {p}" for p in step.params if p not in given]
        if not errors and self._cyclic():
            errors.append("the steps form a cycle")
        return (None, errors) if errors else (Job(self.steps, list(self.edges)), [])

    def _cyclic(self) -> bool:
        left, edges = set(self.steps), set(self.edges)
        while free := left - {b for _, b, _ in edges}:
            left -= free
            edges = {e for e in edges if e[0] in left}
        return bool(left)


class JobService:
    """Jobs in threads of one session; Spark schedules their stages, and progress is that of its stages."""

    def __init__(self, spark: SparkSession, threads: int = 4):
        self.spark, self.pool, self.jobs = spark, ThreadPoolExecutor(threads), {}

    def submit(self, job: Job, output: str, path: str) -> str:
        """Write one output of the job to ``path``; returns the job's id."""
        name = uuid.uuid4().hex

        def run() -> str:
            self.spark.sparkContext.addJobTag(name)
            try:
                frame: DataFrame = job.run([output])[output]
                frame.write.parquet(path)
            finally:
                self.spark.sparkContext.removeJobTag(name)
            return path

        self.jobs[name] = self.pool.submit(run)
        return name

    def progress(self, names: list[str] | None = None) -> dict[str, str]:
        """Each job's state, or an error's text; of all jobs if none is named."""
        return {n: self._state(self.jobs.get(n)) for n in names or list(self.jobs)}

    @staticmethod
    def _state(job: Future | None) -> str:
        if job is None:
            return "error: unknown job"
        if not job.done():
            return "running"
        return f"error: {job.exception()}" if job.exception() else "100.00"

    def result(self, name: str) -> DataFrame:
        """The written output, read back; waits for the job."""
        return self.spark.read.parquet(self.jobs[name].result())

    def shutdown(self) -> None:
        self.pool.shutdown()
