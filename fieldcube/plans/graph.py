"""A dependency graph as two tables, and its operators as joins and aggregates.

nodes(name, payload), edges(src, output, dst, input): an edge hands an output of
``src`` to an input of ``dst``.  Iterations write each round to the shared folder.
"""

from __future__ import annotations

import json
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: The output of a node that has only one.
DEFAULT_OUTPUT = "0"
#: Rows of a plan that may become one text.
TEXT_LIMIT = 100_000


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration by a checkpoint in the folder of spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:  # only on one machine, as in tests
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.gettempdir() + "/fieldcube-checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint()


@dataclass(eq=False)
class Plan:
    nodes: DataFrame
    edges: DataFrame

    def get_node(self, name: str) -> Row:
        """The node's row; a name that no node has is a KeyError."""
        got = self.nodes.where(F.col("name") == name).head(1)
        if not got:
            raise KeyError(name)
        return got[0]

    def equals(self, other: Plan) -> bool:
        """Both have the same nodes with the same payloads, and the same edges, in any order."""

        def same(a: DataFrame, b: DataFrame, cols: list[str]) -> bool:
            a, b = a.select(*cols), b.select(*cols)
            return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

        return same(self.nodes, other.nodes, ["name", "payload"]) and same(self.edges, other.edges, ["src", "output", "dst", "input"])

    def sources(self) -> DataFrame:
        return self.nodes.join(self.edges.select(F.col("dst").alias("name")), "name", "left_anti")

    def sinks(self) -> DataFrame:
        return self.nodes.join(self.edges.select(F.col("src").alias("name")), "name", "left_anti")

    def predecessors(self, name: str) -> DataFrame:
        self.get_node(name)
        return self.edges.where(F.col("dst") == name).select("input", "src", "output")

    def successors(self, name: str) -> DataFrame:
        self.get_node(name)
        return self.edges.where(F.col("src") == name).select("output", "dst", "input")

    def dependants(self) -> DataFrame:
        """(src, output, dependants): how many nodes read each output."""
        return self.edges.groupBy("src", "output").agg(F.count_distinct("dst").alias("dependants"))

    def renamed(self, name: Column) -> Plan:
        """New names by an expression of the column ``name``."""

        def of(c: str) -> DataFrame:
            return self.nodes.select(F.col("name").alias(c), name.alias(f"__{c}"))

        edges = self.edges.join(of("src"), "src").join(of("dst"), "dst")
        return Plan(self.nodes.withColumn("name", name), edges.select(F.col("__src").alias("src"), "output", F.col("__dst").alias("dst"), "input"))

    def __add__(self, other: Plan) -> Plan:
        return Plan(self.nodes.unionByName(other.nodes), self.edges.unionByName(other.edges))

    @staticmethod
    def namespaced(**plans: Plan) -> Plan:
        """The union of plans, each name after "namespace."."""
        out = None
        for space, plan in plans.items():
            part = plan.renamed(F.concat(F.lit(f"{space}."), F.col("name")))
            out = part if out is None else out + part
        if out is None:
            raise ValueError("no plans")
        return out

    def layers(self) -> DataFrame:
        """(name, layer): the longest way from a source; nodes on or behind a cycle are missing."""
        left, edges = _cut(self.nodes.select("name")), _cut(self.edges.select("src", "dst").distinct())
        found, k = None, 0
        while True:
            now = _cut(left.join(edges.select(F.col("dst").alias("name")), "name", "left_anti").withColumn("layer", F.lit(k)))
            if not now.limit(1).count():
                return left.limit(0).withColumn("layer", F.lit(0)) if found is None else found
            found = now if found is None else found.unionByName(now)
            left = _cut(left.join(now, "name", "left_anti"))
            edges = _cut(edges.join(now.select(F.col("name").alias("src")), "src", "left_anti"))
            k += 1

    def has_cycle(self) -> bool:
        return self.layers().count() < self.nodes.count()

    def deduplicated(self) -> Plan:
        """Nodes with equal payload and equal inputs are one, named by the smallest name.

        Layer by layer, so that merged inputs make their readers equal.
        """
        named = _cut(self.nodes.join(self.layers(), "name"))
        depth = named.agg(F.max("layer")).first()[0]
        kept = None
        for k in range(0 if depth is None else depth + 1):
            here = named.where(F.col("layer") == k)
            if kept is not None:
                into = self.edges.join(kept.toDF("src", "to"), "src").groupBy(F.col("dst").alias("name"))
                inputs = into.agg(F.array_sort(F.collect_list(F.struct("input", "to", "output"))).alias("inputs"))
                here = here.join(inputs, "name", "left")
            else:
                here = here.withColumn("inputs", F.lit(None).cast("string"))
            same = here.withColumn("key", F.sha2(F.to_json(F.struct("payload", "inputs")), 256))
            to = same.groupBy("key").agg(F.min("name").alias("to"))
            now = _cut(same.join(to, "key").select("name", "to"))
            kept = now if kept is None else kept.unionByName(now)
        if kept is None:
            return self
        nodes = self.nodes.join(kept.where("name = to").select("name"), "name", "left_semi")
        edges = self.edges.join(kept.toDF("src", "a"), "src").join(kept.toDF("dst", "b"), "dst")
        return Plan(nodes, edges.select(F.col("a").alias("src"), "output", F.col("b").alias("dst"), "input").distinct())

    def split(self, key: Column) -> tuple[Plan, DataFrame]:
        """Nodes with their part (an expression of the node's columns) and the edges inside parts; and the edges cut."""
        parts = self.nodes.withColumn("part", key)
        of = parts.select("name", "part")
        edges = self.edges.join(of.toDF("src", "src_part"), "src").join(of.toDF("dst", "dst_part"), "dst")
        same = F.col("src_part").eqNullSafe(F.col("dst_part"))
        return Plan(parts, edges.where(same).select("src", "output", "dst", "input")), edges.where(~same)

    def components(self) -> DataFrame:
        """(name, component): weakly connected parts, named by their smallest name."""
        pairs = self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        both = _cut(pairs.union(pairs.select("b", "a")).distinct())
        now = _cut(self.nodes.select("name", F.col("name").alias("component")))
        while True:
            near = both.join(now.toDF("b", "c"), "b").groupBy(F.col("a").alias("name")).agg(F.min("c").alias("near"))
            new = now.join(near, "name", "left").select("name", F.col("component").alias("old"), F.least(F.col("component"), F.coalesce("near", "component")).alias("c"))
            jump = now.toDF("c", "up")
            new = _cut(new.join(jump, "c").select("name", "old", F.least("c", "up").alias("component")))
            if not new.where("component < old").limit(1).count():
                return new.select("name", "component")
            now = new.select("name", "component")

    def distances(self) -> DataFrame:
        """(src, dst, d): the fewest edges from a node to each of its descendants."""
        step = _cut(self.edges.select("src", "dst").distinct())
        found = _cut(step.withColumn("d", F.lit(1)))
        last, k = found, 1
        while True:
            k += 1
            more = last.join(step.toDF("dst", "to"), "dst").select("src", F.col("to").alias("dst")).distinct()
            last = _cut(more.join(found, ["src", "dst"], "left_anti").withColumn("d", F.lit(k)))
            if not last.limit(1).count():
                return found
            found = _cut(found.unionByName(last))

    def nearest_common_descendant(self) -> DataFrame:
        """(a, b, d): for each two different nodes the least of max(d(a, c), d(b, c)) over common descendants c, a node being its own at 0."""
        own = self.nodes.select(F.col("name").alias("src"), F.col("name").alias("dst"), F.lit(0).alias("d"))
        far = _cut(self.distances().unionByName(own))
        pairs = far.toDF("a", "c", "da").join(far.toDF("b", "c", "db"), "c").where("a < b")
        return pairs.groupBy("a", "b").agg(F.min(F.greatest("da", "db")).alias("d"))

    def values(self) -> DataFrame:
        """(name, value): the nodes on the longest way of the node's component, less the fewest edges from the node to a sink."""
        back = Plan(self.nodes, self.edges.select(F.col("dst").alias("src"), "output", F.col("src").alias("dst"), "input"))
        parts = self.components()
        depth = parts.join(back.layers(), "name").groupBy("component").agg((F.max("layer") + 1).alias("depth"))
        step = _cut(self.edges.select("src", "dst").distinct())
        last = near = _cut(self.sinks().select("name", F.lit(0).alias("d")))
        k = 0
        while not last.isEmpty():
            k += 1
            more = step.join(last.select(F.col("name").alias("dst")), "dst").select(F.col("src").alias("name")).distinct()
            last = _cut(more.join(near, "name", "left_anti").withColumn("d", F.lit(k)))
            near = near.unionByName(last)
        return near.join(parts, "name").join(depth, "component").select("name", (F.col("depth") - F.col("d")).alias("value"))

    def accumulated(self, costs: DataFrame, once: bool = False) -> DataFrame:
        """(name, total): a node's cost (name, cost) and those of its ancestors, counted once for each path or, with ``once``, once."""
        if once:
            up = self.distances().join(costs.toDF("src", "cost"), "src").groupBy(F.col("dst").alias("name")).agg(F.sum("cost").alias("up"))
            return costs.join(up, "name", "left").select("name", (F.col("cost") + F.coalesce("up", F.lit(0.0))).alias("total"))
        named = _cut(self.nodes.join(self.layers(), "name").join(costs, "name"))
        depth = named.agg(F.max("layer")).first()[0]
        done = _cut(named.where("layer = 0").select("name", F.col("cost").alias("total")))
        step = self.edges.select("src", "dst").distinct()
        for k in range(1, 1 + (depth or 0)):
            up = step.join(done.toDF("src", "t"), "src").groupBy(F.col("dst").alias("name")).agg(F.sum("t").alias("up"))
            done = _cut(done.unionByName(named.where(F.col("layer") == k).join(up, "name").select("name", (F.col("cost") + F.col("up")).alias("total"))))
        return done

    def described(self) -> DataFrame:
        """(name, payload, inputs, outputs): one row a node, inputs as a map from input to (src, output), outputs those that are read."""
        entry = F.struct("input", F.struct("src", "output"))
        ins = self.edges.groupBy(F.col("dst").alias("name")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("inputs"))
        outs = self.edges.groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_set("output")).alias("outputs"))
        return self.nodes.select("name", "payload").join(ins, "name", "left").join(outs, "name", "left")

    def serialise(self) -> dict:
        """{name: {inputs, outputs, payload}} of a plan small enough for the driver; an input is a name, or (name, output) if not the default one."""
        rows = self.described().limit(TEXT_LIMIT + 1).collect()
        if len(rows) > TEXT_LIMIT:
            raise ValueError("the plan is too large for one text; write its tables")
        found = {}
        for r in rows:
            inputs = {k: x.src if x.output == DEFAULT_OUTPUT else [x.src, x.output] for k, x in (r.inputs or {}).items()}
            found[r.name] = {"inputs": inputs, "outputs": r.outputs or []} | ({} if r.payload is None else {"payload": r.payload})
        return found

    @staticmethod
    def deserialise(spark, data: dict) -> Plan:
        """The plan of ``serialise``; an input from a name that is no node is a KeyError."""
        edges = [(*((x, DEFAULT_OUTPUT) if isinstance(x, str) else x), name, k) for name, d in data.items() for k, x in d.get("inputs", {}).items()]
        if lost := {e[0] for e in edges} - set(data):
            raise KeyError(sorted(lost)[0])
        nodes = spark.createDataFrame([(name, d.get("payload")) for name, d in data.items()], "name string, payload string")
        return Plan(nodes, spark.createDataFrame(edges, "src string, output string, dst string, input string"))

    def to_json(self) -> str:
        """A text of a plan small enough for the driver."""
        rows = {t: [r.asDict(recursive=True) for r in df.limit(TEXT_LIMIT + 1).collect()] for t, df in (("nodes", self.nodes), ("edges", self.edges))}
        if max(map(len, rows.values())) > TEXT_LIMIT:
            raise ValueError("the plan is too large for one text; write its tables")
        return json.dumps(rows, sort_keys=True)

    @staticmethod
    def from_json(spark, text: str) -> Plan:
        rows = json.loads(text)
        nodes = spark.createDataFrame([(r["name"], r["payload"]) for r in rows["nodes"]], "name string, payload string")
        edges = spark.createDataFrame([(r["src"], r["output"], r["dst"], r["input"]) for r in rows["edges"]], "src string, output string, dst string, input string")
        return Plan(nodes, edges)

    def to_dot(self) -> str:
        rows = json.loads(self.to_json())
        lines = [f'  "{r["name"]}";' for r in rows["nodes"]]
        lines += [f'  "{r["src"]}" -> "{r["dst"]}" [taillabel="{r["output"]}", headlabel="{r["input"]}"];' for r in rows["edges"]]
        return "digraph {\n" + "\n".join(lines) + "\n}"
