"""The registered queries of the library's own operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cube import Cube
from .operators import ensemble, traces
from .plans import samples
from .plans.graph import Plan
from .sources import from_arrays, from_files, from_frame, from_parts, generated

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The embeddings as an ensemble: ten members, steps of ten vectors, elements i.
E = """WITH e AS (SELECT (vec_id % 10)::BIGINT AS member, (vec_id // 10)::BIGINT AS step,
 (generate_subscripts(embedding, 1) - 1)::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("member"), F.expr("vec_id div 10").alias("step"), "embedding")


def ens(spark: SparkSession, sf: str) -> Cube:
    return from_arrays(_vectors(spark, sf), ["member", "step"], "embedding", coords={"member": list(range(10))})


def grid(spark: SparkSession, sf: str) -> Cube:
    """Quantities of lineitem by flag, status and line number; rows of a cell need no number."""
    return from_frame(_table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], [], ["l_quantity"])


def rounded(cube: Cube | DataFrame, *values: str, digits: int = 6) -> DataFrame:
    df = cube.df if isinstance(cube, Cube) else cube
    return df.withColumns({v: _r(F.col(v), digits) for v in values or ("v",)})


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)  # no negative zero


def R(x: str, name: str = "v", digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


@query(f"{E} SELECT member, step, i, v FROM e")
def source_unpack(spark, sf):
    return ens(spark, sf).df


@query(f"{E} SELECT member, step, i, {R('v * 2')} FROM e")
def map_scale(spark, sf):
    return rounded(ens(spark, sf).map(lambda v: v * 2))


@query(f"{E} SELECT member, step, i, {R('v * (member + 1)')} FROM e")
def map_each_member(spark, sf):
    return rounded(ens(spark, sf).map_each(lambda v, k: v * k, "member", [float(k + 1) for k in range(10)]))


@query(f"{E} SELECT step, i, v FROM e WHERE member = 3")
def select_label(spark, sf):
    return ens(spark, sf).select(member=3).df


@query(f"{E} SELECT member, step, i, v FROM e WHERE member IN (7, 2) AND step IN (1, 4)")
def select_list(spark, sf):
    return ens(spark, sf).select(member=[7, 2], step=[4, 1]).df


@query(f"{E} SELECT member, i, v FROM e WHERE step = (SELECT max(step) FROM e) AND member IN (0, 9)")
def iselect_position(spark, sf):
    return ens(spark, sf).iselect(step=-1, member=[0, -1]).df


@query(f"{E} SELECT member, step, CASE i WHEN 5 THEN 0 WHEN 2 THEN 1 ELSE 2 END::INT AS i, v FROM e WHERE i IN (5, 2, 60)")
def take_inner(spark, sf):
    return ens(spark, sf).take("i", [5, 2, 60]).df


@query(f"{E} SELECT member, step, chr(97 + i) AS level, v FROM e WHERE i < 4")
def expand_inner(spark, sf):
    return ens(spark, sf).expand("level", "i", labels=["a", "b", "c", "d"]).df


@query(f"{E} SELECT step, member::INT AS number, i, v FROM e")
def stack_members(spark, sf):
    return ens(spark, sf).stack("member", "number").df


@query(f"{E} SELECT member, (step * 64 + i)::BIGINT AS i, v FROM e")
def concatenate_steps(spark, sf):
    return ens(spark, sf).concatenate("step").df


@query(f"{E} SELECT member, step, i, v FROM e WHERE member < 2 UNION ALL SELECT member, step, i, v FROM e WHERE member = 5")
def join_existing(spark, sf):
    c = ens(spark, sf)
    return c.select(member=[0, 1]).join(c.select(member=[5]), "member").df


@query(f"{E} SELECT t AS threshold, step, i, {R('avg((v <= t)::INT) * 100')} FROM e, (VALUES (-0.1::DOUBLE), (0.0), (0.1)) AS x(t) GROUP BY ALL")
def transform_thresholds(spark, sf):
    out = ens(spark, sf).transform_values(lambda v, t: (v <= t).cast("double"), [-0.1, 0.0, 0.1], "threshold").mean("member")
    return rounded(out.map(lambda v: v * 100))


def _reductions() -> None:
    sql = {"sum": "sum(v)", "mean": "avg(v)", "std": "stddev_pop(v)", "var": "var_pop(v)", "min": "min(v)", "max": "max(v)", "norm": "sqrt(sum(v * v))"}
    for how, x in sql.items():

        def run(spark, sf, how=how):
            return rounded(ens(spark, sf).reduce(how, "member"))

        QUERIES[f"reduce_{how}"], ORACLES[f"reduce_{how}"] = run, f"{E} SELECT step, i, {R(x)} FROM e GROUP BY step, i"


_reductions()


@query(f"{E} SELECT step, i, {R('product(v + 1)')} FROM e GROUP BY step, i")
def reduce_prod(spark, sf):
    return rounded(ens(spark, sf).add(1.0).prod("member"))


@query(f"{E} SELECT '0-9' AS member, step, i, {R('avg(v)')} FROM e GROUP BY step, i")
def reduce_batched_keep(spark, sf):
    return rounded(ens(spark, sf).mean("member", batch_size=3, keep_dim=True).df.select("member", "step", "i", "v"))


@query(f"{E} SELECT member, step, {R('max(v)')} FROM e GROUP BY member, step")
def reduce_inner(spark, sf):
    return rounded(ens(spark, sf).reduce_inner("max"))


@query(f"{E} SELECT step, i, {R('sum(v * v)')} FROM e GROUP BY step, i")
def reduce_python(spark, sf):
    return rounded(ens(spark, sf).reduce_arrays(lambda a: np.square(a).sum(0), "member"))


@query(f"{E} SELECT step, i, {R('quantile_cont(v, 0.8)')} FROM e GROUP BY step, i")
def quantile_80(spark, sf):
    return rounded(ens(spark, sf).quantile(0.8, "member"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(l_quantity), 6) + 0.0 AS l_quantity FROM lineitem GROUP BY ALL")
def grid_mean(spark, sf):
    return rounded(grid(spark, sf).reduce_inner("mean"), "l_quantity")


@query("SELECT o_orderpriority, quarter(o_orderdate)::INT AS season, round(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE, 2) AS o_totalprice FROM orders GROUP BY ALL")
def group_season(spark, sf):
    c = from_frame(_table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")), ["o_orderpriority", "o_orderdate"], [], ["o_totalprice"])
    return rounded(c.group("o_orderdate", F.quarter, "sum", "season").df.withColumn("o_totalprice", F.col("o_totalprice").cast("double")), "o_totalprice", digits=2)


@query(f"{E} SELECT member, step, i, {R('(v * 3 - 1) / 4')} FROM e")
def scalar_arithmetic(spark, sf):
    return rounded(ens(spark, sf).multiply(3).subtract(1).divide(4))


@query("SELECT count(*) AS rows, count(*) FILTER (l_tax = 0 AND l_discount > 0) AS infinite, count(*) FILTER (l_tax = 0 AND l_discount = 0) AS nans FROM lineitem")
def divide_ieee(spark, sf):
    from .functions import divide

    q = _table(spark, sf, "lineitem").select(divide(F.col("l_discount"), F.col("l_tax")).alias("q"))
    return q.agg(F.count("*").alias("rows"), F.count_if(F.col("q") == float("inf")).alias("infinite"), F.count_if(F.isnan("q")).alias("nans"))


@query(f"{E} SELECT member, step, list(v ORDER BY i)[1:3] AS v FROM e GROUP BY member, step")
def packed_cells(spark, sf):
    return ens(spark, sf).packed().withColumn("v", F.slice("v", 1, 3))


@query("SELECT r_regionkey::BIGINT AS part, n_nationkey::INT AS i, n_nationkey::DOUBLE AS v FROM nation, region WHERE n_regionkey = r_regionkey")
def source_parts(spark, sf):
    n = _table(spark, sf, "nation")
    parts = [n.where(F.col("n_regionkey") == k).select(F.col("n_nationkey").alias("i"), F.col("n_nationkey").cast("double").alias("v")) for k in range(5)]
    return from_parts(parts, {"part": list(range(5))}, ["i"]).df.withColumn("part", F.col("part").cast("long"))


@query(f"{E} SELECT step, i, {R('avg(v)', 'mean')}, {R('stddev_pop(v)', 'std')} FROM e GROUP BY step, i")
def ensms(spark, sf):
    return rounded(ensemble.ensms(ens(spark, sf)), "mean", "std")


@query("SELECT count(*) AS fields, count(DISTINCT n_regionkey) AS regions FROM nation")
def metadata_override(spark, sf):
    n = _table(spark, sf, "nation").withColumn("meta", F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("edition"), F.lit("2")))
    n = Cube(n, ["n_nationkey"], [], ["meta"]).set_metadata("meta", edition=1).df
    return n.where(F.col("meta")["edition"] == "1").agg(F.count("*").alias("fields"), F.count_distinct(F.col("meta")["region"]).alias("regions"))


# Windows over all steps: window k holds steps 5 k to 5 k + 9.

V = f"{E}, s AS (SELECT member, step, i, v, step // 5 - k AS win FROM e, (VALUES (0), (1)) AS x(k) WHERE step // 5 >= k)"


@query(f"{E} SELECT member, CASE step % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS window, i, max(v) AS v FROM e GROUP BY ALL UNION ALL SELECT member, 'all', i, max(v) FROM e GROUP BY ALL")
def windows_listed(spark, sf):
    c = ens(spark, sf)
    steps = c.labels("step")
    return ensemble.window_operation(c, "max", {"even": [s for s in steps if s % 2 == 0], "odd": [s for s in steps if s % 2], "all": steps}).df


@query(f"{V} SELECT member, win AS window, i, min(v) AS v FROM s GROUP BY ALL")
def window_min(spark, sf):
    return ensemble.running_windows(ens(spark, sf), "min", 10, 5).df


@query(f"{V}, m AS (SELECT member, win, i, min(v) AS v FROM s GROUP BY ALL) SELECT win AS window, i, {R('avg((v <= -0.1)::INT) * 100')} FROM m GROUP BY ALL")
def window_probability(spark, sf):
    return rounded(ensemble.threshold_prob(ensemble.running_windows(ens(spark, sf), "min", 10, 5), "<=", -0.1))


@query(
    f"""{V}, k AS (SELECT unnest(range(101)) AS k), p AS (SELECT k, 2 * asin(sqrt(k / 100.0::DOUBLE)) AS a FROM k),
wt AS (SELECT k, (lead(a, 1, a) OVER (ORDER BY k) - lag(a, 1, a) OVER (ORDER BY k)) / 2 AS w FROM p),
c AS (SELECT win, i, quantile_cont(v, [x / 100.0::DOUBLE for x in range(101)]) AS q FROM s WHERE step % 2 = 0 GROUP BY win, i),
f AS (SELECT member, win, i, avg(v) AS v FROM s WHERE step % 2 = 1 GROUP BY member, win, i),
b AS (SELECT win, i, k, avg((v < q[k + 1])::INT) AS below FROM f JOIN c USING (win, i), k GROUP BY win, i, k),
x AS (SELECT win, i, 2 / pi() * sum(w * (k / 100.0::DOUBLE - below)) AS efi FROM b JOIN wt USING (k) GROUP BY win, i),
t AS (SELECT win, i, quantile_cont(v, 0.1) AS f10, quantile_cont(v, 0.9) AS f90 FROM f GROUP BY win, i)
SELECT win AS window, i, {R('efi', 'efi', 5)}, {R('(f10 - q[2]) / (q[2] - q[11])', 'sot10', 5)}, {R('(f90 - q[100]) / (q[100] - q[91])', 'sot90', 5)}
FROM x JOIN c USING (win, i) JOIN t USING (win, i)"""
)
def extreme_index(spark, sf):
    c = ens(spark, sf)
    even, odd = (c._new(c.df.where(F.col("step") % 2 == k)) for k in (0, 1))
    clim = ensemble.climatology(ensemble.in_windows(even, 10, 5), ["member", "step"])
    return rounded(ensemble.extreme(ensemble.running_windows(odd, "mean", 10, 5), clim), "efi", "sot10", "sot90", digits=5)


@query(f"{E} SELECT member, step, i, {R('v * v')} FROM e")
def map_python(spark, sf):
    return rounded(ens(spark, sf).map_arrays(lambda a: a * a))


@query(f"{E} SELECT a.member, a.step, a.i, CASE WHEN b.v <= 0 THEN 0.0 ELSE a.v END AS v FROM e a JOIN e b ON b.member = (a.member + 1) % 10 AND a.step = b.step AND a.i = b.i")
def mask_filter(spark, sf):
    c = ens(spark, sf)
    return c.mask(c._new(c.df.withColumn("member", (F.col("member") + 9) % 10)), "<=", 0.0).df


@query(f"{E} SELECT 'raw' AS kind, member, step, i, v FROM e UNION ALL SELECT 'twice', member, step, i, v * 2 FROM e")
def join_new(spark, sf):
    c = ens(spark, sf)
    return c.join(c.map(lambda v: v * 2), "kind", ["raw", "twice"]).df


@query(f"{E} SELECT l AS level, member, step, i, v FROM e, (VALUES ('low'), ('high')) AS x(l)")
def broadcast_dims(spark, sf):
    c = ens(spark, sf)
    return c.broadcast(Cube(c.df.limit(0).withColumn("level", F.lit("")), ["level"], [], ["v"], {"level": ["low", "high"]})).df


@query(f"{E} SELECT k AS power, member, step, i, {R('v ** k')} FROM e, (VALUES (2), (3)) AS x(k)")
def transform_union(spark, sf):
    return rounded(ens(spark, sf).transform(lambda c, k: c.power(k), [2, 3], "power"))


@query(f"{E} SELECT member, step, i, n, {R('v * n')} FROM e, (VALUES (1), (2), (3)) AS x(n)")
def yields_multiples(spark, sf):
    return rounded(ens(spark, sf).yields([lambda v, k=k: v * k for k in (1, 2, 3)], "n", [1, 2, 3]))


def _binary() -> None:
    sql = {"add": "a.v + b.v", "subtract": "a.v - b.v", "multiply": "a.v * b.v", "divide": "a.v / b.v", "diff": "b.v - a.v"}
    for how, x in sql.items():

        def run(spark, sf, how=how):
            c = ens(spark, sf)
            return rounded(c.select(member=list(range(5))).combine(c.select(member=list(range(5, 10))), how))

        QUERIES[f"binary_{how}"] = run
        ORACLES[f"binary_{how}"] = f"{E} SELECT a.member, a.step, a.i, {R(x)} FROM e a JOIN e b ON b.member = a.member + 5 AND a.step = b.step AND a.i = b.i"


_binary()


@query(f"{E} SELECT member, step, i, {R('v * (10 * step + member)')} FROM e")
def map_each_cell(spark, sf):
    """A parameter for each member and step, as many as there are vectors: a cube of its own, not a list in the driver."""
    cells = _vectors(spark, sf).select("member", "step").distinct()
    params = from_frame(cells.withColumn("k", (10 * F.col("step") + F.col("member")).cast("double")), ["member", "step"], [], ["k"])
    return rounded(ens(spark, sf).map_each(lambda v, k: v * k, ["member", "step"], params))


@query(f"{E} SELECT member, step, i, {R('CASE member % 3 WHEN 0 THEN v WHEN 1 THEN -v ELSE v * v END')} FROM e")
def map_functions(spark, sf):
    kinds = [lambda v: v, lambda v: -v, lambda v: v * v]
    return rounded(ens(spark, sf).map_cells([kinds[m % 3] for m in range(10)], "member"))


@query(f"{E} SELECT member, step, i, CASE k WHEN 0 THEN 'plain' ELSE 'square' END AS kind, {R('CASE k WHEN 0 THEN v ELSE v * v END')} FROM e, (VALUES (0), (1)) AS x(k)")
def yields_python(spark, sf):
    def both(a):
        yield a
        yield a * a

    return rounded(ens(spark, sf).yields_arrays(both, "kind", ["plain", "square"]))


@query(f"{E}, r AS (SELECT step, i, min(v) AS a, max(v) AS b, avg(v) AS c FROM e GROUP BY step, i) SELECT step, i, kind, {R('CASE kind WHEN $$low$$ THEN a WHEN $$high$$ THEN b ELSE c END')} FROM r, (VALUES ('low'), ('high'), ('mean')) AS x(kind)")
def reduce_yields(spark, sf):
    return rounded(ens(spark, sf).reduce_yields(["min", "max", F.avg], "kind", ["low", "high", "mean"], "member"))


@query(f"{E}, r AS (SELECT step, i, sum(v) AS a, median(v) AS b FROM e GROUP BY step, i) SELECT step, i, kind, {R('CASE kind WHEN $$sum$$ THEN a ELSE b END')} FROM r, (VALUES ('sum'), ('median')) AS x(kind)")
def reduce_python_yields(spark, sf):
    return rounded(ens(spark, sf).reduce_arrays(lambda a: (a.sum(0), np.median(a, 0)), "member", yields=("kind", ["sum", "median"])))


@query(f"{E} SELECT member, step, i, v FROM e WHERE i IN (60, 5)")
def take_labels(spark, sf):
    return ens(spark, sf).take("i", [60, 5], method="sel").df


@query(f"{E} SELECT step, member::INT AS member, i, v FROM e")
def flatten_members(spark, sf):
    return ens(spark, sf).flatten("member").df


@query(f"{E} SELECT member, step, i, {R('pow(v * v, v + 1)')} FROM e")
def binary_power(spark, sf):
    c = ens(spark, sf)
    return rounded(c.multiply(c, align="label").power(c.add(1), align="label"))


@query("SELECT 'supplier' AS source, s_suppkey, s_acctbal FROM supplier")
def source_files(spark, sf):
    return from_files(spark, f"{sf}/supplier.parquet", r"([a-z]+)\.parquet", {"source": "string"}, ["s_suppkey"], ["s_acctbal"]).df


@query("SELECT member::INT AS member, 5000::BIGINT AS elements, true AS inside, true AS even FROM (VALUES (0), (1), (2)) AS x(member)")
def source_random(spark, sf):
    """Seeded numbers: how many, whether in [0, 1), and whether each tenth holds about a tenth of them."""
    df = generated(spark, {"member": [0, 1, 2]}, 5000, seed=3).df
    tenths = df.groupBy("member", F.floor(F.col("v") * 10).alias("t")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    return tenths.groupBy("member").agg(F.sum("n").alias("elements"), F.bool_and((F.col("a") >= 0) & (F.col("b") < 1)).alias("inside"), (F.bool_and(F.abs(F.col("n") - 500) < 150) & (F.count("*") == 10)).alias("even"))


# Graphs: customers hang on nations, nations on regions.

GRAPH = """nodes AS (SELECT 'r' || r_regionkey AS name, 'region' AS payload FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, c_mktsegment FROM customer),
edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""


def plan(spark: SparkSession, sf: str) -> Plan:
    r, n, c = (_table(spark, sf, t) for t in ("region", "nation", "customer"))

    def name(k: str, col: str) -> Column:
        return F.concat(F.lit(k), F.col(col).cast("string"))

    nodes = r.select(name("r", "r_regionkey").alias("name"), F.lit("region").alias("payload"))
    nodes = nodes.union(n.select(name("n", "n_nationkey"), F.lit("nation"))).union(c.select(name("c", "c_custkey"), "c_mktsegment"))
    edges = n.select(name("r", "n_regionkey").alias("src"), F.lit("0").alias("output"), name("n", "n_nationkey").alias("dst"), F.lit("in").alias("input"))
    return Plan(nodes, edges.union(c.select(name("n", "c_nationkey"), F.lit("0"), name("c", "c_custkey"), F.lit("in"))))


@query(f"WITH {GRAPH} SELECT name, payload FROM nodes WHERE name NOT IN (SELECT src FROM edges)")
def graph_sinks(spark, sf):
    return plan(spark, sf).sinks()


@query(f"WITH {GRAPH} SELECT name, payload FROM nodes WHERE name NOT IN (SELECT dst FROM edges)")
def graph_sources(spark, sf):
    return plan(spark, sf).sources()


@query(f"WITH {GRAPH} SELECT src, '0' AS output, count(DISTINCT dst) AS dependants FROM edges GROUP BY src")
def graph_dependants(spark, sf):
    return plan(spark, sf).dependants()


@query(f"WITH {GRAPH} SELECT name, CASE left(name, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END::INT AS layer FROM nodes")
def graph_layers(spark, sf):
    return plan(spark, sf).layers()


@query(
    f"WITH {GRAPH}, t AS (SELECT name, name AS root FROM nodes WHERE left(name, 1) = 'r' UNION ALL SELECT dst, src FROM edges WHERE left(src, 1) = 'r' UNION ALL SELECT b.dst, a.src FROM edges a JOIN edges b ON a.dst = b.src) SELECT name, min(name) OVER (PARTITION BY root) AS component FROM t"
)
def graph_components(spark, sf):
    return plan(spark, sf).components()


@query(f"WITH {GRAPH} SELECT src, dst, 1 AS d FROM edges UNION ALL SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src")
def graph_distances(spark, sf):
    return plan(spark, sf).distances()


@query("SELECT DISTINCT c_mktsegment AS payload, 'n' || first_n AS src FROM customer JOIN nation ON c_nationkey = n_nationkey, (SELECT min(n_nationkey::VARCHAR) AS first_n FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region ORDER BY 'r' || r_regionkey LIMIT 1)) WHERE true")
def graph_deduplicated(spark, sf):
    """All regions are equal, so their nations are, so customers of one segment are: one node a layer and segment."""
    p = plan(spark, sf).deduplicated()
    return p.nodes.where(F.col("name").startswith("c")).join(p.edges, F.col("name") == F.col("dst")).select("payload", "src")


@query(f"WITH {GRAPH} SELECT name, CASE left(name, 1) WHEN 'r' THEN 1.0 WHEN 'n' THEN 2.0 ELSE 3.0 END::DOUBLE AS total FROM nodes")
def graph_accumulated(spark, sf):
    p = plan(spark, sf)
    return p.accumulated(p.nodes.select("name", F.lit(1.0).alias("cost")))


@query(
    f"WITH {GRAPH}, f AS (SELECT name AS s, name AS c, 0 AS d FROM nodes UNION ALL SELECT src, dst, 1 FROM edges UNION ALL SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src) SELECT x.s AS a, y.s AS b, min(greatest(x.d, y.d)) AS d FROM f x JOIN f y ON x.c = y.c AND x.s < y.s GROUP BY ALL"
)
def graph_nearest_common(spark, sf):
    return plan(spark, sf).nearest_common_descendant()


@query(f"WITH {GRAPH} SELECT src, dst FROM edges WHERE left(dst, 1) = 'c'")
def graph_split(spark, sf):
    """The edges cut between customers and the rest."""
    return plan(spark, sf).split(F.col("name").startswith("c"))[1].select("src", "dst")


@query(f"WITH {GRAPH} SELECT s || '.' || src AS src, s || '.' || dst AS dst FROM edges, (VALUES ('x'), ('y')) AS x(s)")
def graph_namespaced(spark, sf):
    p = plan(spark, sf)
    return Plan.namespaced(x=p, y=p).edges.select("src", "dst")


def _shortcuts(spark: SparkSession, sf: str) -> Plan:
    """The graph with an edge from each region to the customers of its nations."""
    p = plan(spark, sf)
    more = p.edges.alias("a").join(p.edges.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "a.output", "b.dst", F.lit("region").alias("input"))
    return Plan(p.nodes, p.edges.unionByName(more))


@query(f"WITH {GRAPH} SELECT name, CASE left(name, 1) WHEN 'r' THEN 1.0 WHEN 'n' THEN 2.0 ELSE 3.0 END::DOUBLE AS total FROM nodes")
def graph_accumulated_once(spark, sf):
    p = _shortcuts(spark, sf)
    return p.accumulated(p.nodes.select("name", F.lit(1.0).alias("cost")), once=True)


@query(f"WITH {GRAPH} SELECT name, CASE left(name, 1) WHEN 'r' THEN 1.0 WHEN 'n' THEN 2.0 ELSE 4.0 END::DOUBLE AS total FROM nodes")
def graph_accumulated_paths(spark, sf):
    p = _shortcuts(spark, sf)
    return p.accumulated(p.nodes.select("name", F.lit(1.0).alias("cost")))


@query(
    f"""WITH {GRAPH}, n AS (SELECT a.src AS r, a.dst AS name, max(b.dst IS NOT NULL)::INT AS d FROM edges a LEFT JOIN edges b ON a.dst = b.src WHERE left(a.src, 1) = 'r' GROUP BY ALL),
r AS (SELECT name AS r, coalesce(max(d) + 2, 1) AS depth, coalesce(min(d) + 1, 0) AS d FROM nodes LEFT JOIN (SELECT r, d FROM n) ON r = name WHERE left(name, 1) = 'r' GROUP BY name)
SELECT r AS name, (depth - d)::INT AS value FROM r UNION ALL SELECT n.name, (depth - n.d)::INT FROM n JOIN r USING (r) UNION ALL SELECT e.dst, depth::INT FROM edges e JOIN n ON e.src = n.name JOIN r USING (r)"""
)
def graph_values(spark, sf):
    return plan(spark, sf).values()


@query(f"WITH {GRAPH} SELECT name, payload, e.src, CASE WHEN name IN (SELECT src FROM edges) THEN 1 ELSE 0 END::INT AS outputs FROM nodes LEFT JOIN edges e ON e.dst = name")
def graph_described(spark, sf):
    df = plan(spark, sf).described()
    return df.select("name", "payload", F.try_element_at("inputs", F.lit("in"))["src"].alias("src"), F.coalesce(F.size("outputs"), F.lit(0)).alias("outputs")).withColumn("outputs", F.greatest("outputs", F.lit(0)))


@query("SELECT 'comb' AS shape, 'join-' || k AS name, (k + 1)::INT AS layer FROM range(4) AS x(k) UNION ALL SELECT 'comb', 'reader-' || k, 0 FROM range(5) AS x(k) UNION ALL SELECT 'comb', 'writer', 5 UNION ALL SELECT 'linear', 'process-' || k, (k + 1)::INT FROM range(5) AS x(k) UNION ALL SELECT 'linear', 'reader', 0 UNION ALL SELECT 'linear', 'writer', 6")
def graph_samples(spark, sf):
    shapes = {"comb": samples.comb(spark), "linear": samples.linear(spark)}
    parts = [p.layers().withColumn("shape", F.lit(k)) for k, p in shapes.items()]
    return parts[0].unionByName(parts[1])


# Traces: the events as a log of users' actions.

ACTIONS = ["view", "click", "purchase"]


@query("SELECT user_id AS task, 'w' AS worker, min(epoch_us(ts)) FILTER (event_type = 'view') AS view, min(epoch_us(ts)) FILTER (event_type = 'click') AS click, min(epoch_us(ts)) FILTER (event_type = 'purchase') AS purchase, click - view AS decide, purchase - click AS buy FROM events GROUP BY user_id")
def trace_durations(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("user_id").alias("task"), F.lit("w").alias("worker"), F.col("event_type").alias("action"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return traces.task_durations(rows, ACTIONS, [("decide", "click", "view"), ("buy", "purchase", "click")])


@query("SELECT event_id, user_id, max_by(mode, (epoch_us(ts), mode)) OVER (PARTITION BY user_id) AS mode FROM (SELECT *, CASE WHEN event_type = 'click' THEN props END AS mode FROM events)")
def trace_filled(spark, sf):
    rows = _table(spark, sf, "events").withColumn("mode", F.when(F.col("event_type") == "click", F.col("props")))
    return traces.filled(rows, ["mode"], ["user_id"], "ts").select("event_id", "user_id", "mode")


@query("SELECT event_type AS kind, sum((value * 100)::BIGINT)::BIGINT AS duration_ns_sum, count(*) AS duration_ns_cnt, round(avg((value * 100)::BIGINT), 4) AS duration_ns_avg FROM events GROUP BY event_type")
def trace_microtraces(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("duration_ns"))
    return rounded(traces.microtrace_stats(rows), "duration_ns_avg", digits=4)


@query("SELECT 'task' AS kind, event_type AS action, user_id::VARCHAR AS task, 'w' || event_id % 4 AS worker, NULL::VARCHAR AS dataset, NULL::VARCHAR AS source, NULL::VARCHAR AS target, NULL::VARCHAR AS mode, epoch_us(ts) AS at FROM events")
def trace_marks(spark, sf):
    """The events as lines of a log, parsed."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    line = F.format_string("noise mark #action=task_%s;task=%d;worker=w%d;at=%s", "event_type", "user_id", F.col("event_id") % 4, at)
    return traces.marks(_table(spark, sf, "events").select(line.alias("value")), "mark")


@query("SELECT event_type AS kind, 1 + event_id % 100 AS duration_ns FROM events")
def trace_microtrace_lines(spark, sf):
    line = F.concat(F.lit("noise trace #"), "event_type", F.lit("="), (1 + F.col("event_id") % 100).cast("string"))
    return traces.microtraces(_table(spark, sf, "events").select(line.alias("value")), "trace")


TRANSFERS = """t AS (SELECT user_id::VARCHAR AS dataset, 'h' || event_id % 2 AS target, list_element(['planned', 'started', 'loaded', 'received', 'unloaded', 'completed'], (event_id // 2 % 6 + 1)::INT) AS action, epoch_us(ts) AS x, CASE WHEN event_id // 2 % 6 = 0 THEN event_type END AS m FROM events),
f AS (SELECT *, max_by(m, (x, m)) FILTER (m IS NOT NULL) OVER (PARTITION BY dataset, target) AS mode FROM t),
d AS (SELECT dataset, target, mode AS source, mode, min(x) FILTER (action = 'planned') AS p, min(x) FILTER (action = 'started') AS s, min(x) FILTER (action = 'completed') AS c FROM f GROUP BY dataset, target, mode)"""


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.expr("event_id div 2 % 6")
    mode = F.when(k == 0, F.col("event_type"))
    action = F.element_at(F.array(*[F.lit(a) for a in traces.TRANSMIT_ACTIONS]), (k + 1).cast("int"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _table(spark, sf, "events").select(F.col("user_id").cast("string").alias("dataset"), F.concat(F.lit("h"), (F.col("event_id") % 2).cast("string")).alias("target"), action.alias("action"), at.alias("at"), mode.alias("mode"), mode.alias("source"))
    return traces.transmit_durations(rows)


@query(f"WITH {TRANSFERS} SELECT dataset, target, source, mode, c - p AS total, s - p AS comm2source FROM d")
def trace_transmits(spark, sf):
    return transfers(spark, sf).select("dataset", "target", "source", "mode", "total", "comm2source")


@query(f"WITH {TRANSFERS} SELECT target, sum(c - p)::BIGINT AS total_sum, round(avg(c - p), 2) AS total_mean, max(c - p) AS total_max FROM d GROUP BY target")
def trace_summary(spark, sf):
    return rounded(traces.summary(transfers(spark, sf), ["total"], ["target"]), "total_mean", digits=2)


@query(
    """WITH p AS (SELECT user_id, event_id AS key, epoch_us(ts) AS created, CASE WHEN event_type <> 'error' THEN epoch_us(ts) + 1 END AS f, CASE WHEN event_type <> 'error' THEN epoch_us(ts) + 1 + (event_type = 'view')::INT END AS l, 1 + event_id % 7 AS size FROM events),
c AS (SELECT *, (CASE WHEN f IS NULL THEN 2 WHEN f = l THEN 0 ELSE 1 END)::INT AS class FROM p),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY class, CASE class WHEN 0 THEN created WHEN 1 THEN l ELSE -created END, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before FROM c)
SELECT user_id, key, class, freed_before FROM s WHERE freed_before < 20"""
)
def trace_page_out(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    read = F.when(F.col("event_type") != "error", at + 1)
    pages = _table(spark, sf, "events").select("user_id", F.col("event_id").alias("key"), at.alias("created"), read.alias("retrieved_first"), (read + (F.col("event_type") == "view").cast("int")).alias("retrieved_last"), (1 + F.col("event_id") % 7).alias("size"))
    return traces.page_out(pages, 20, ["user_id"]).select("user_id", "key", "class", "freed_before")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, round(sum(value::DECIMAL(18, 2))::DOUBLE, 2) AS value FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    from .streaming import windowed

    rows = _table(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return windowed(rows, "ts", "1 hour", "sum", "value", ["event_type"]).withColumn("value", F.col("value").cast("double"))
