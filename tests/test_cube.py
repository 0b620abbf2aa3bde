import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcube import Cube
from fieldcube import functions as fn
from fieldcube.operators import ensemble, traces
from fieldcube.plans import samples
from fieldcube.plans.graph import Plan
from fieldcube.plans.jobs import JobBuilder, JobService, Step
from fieldcube.sources import from_arrays, from_frame, from_parts, generated
from fieldcube.streaming import windowed

X = np.random.default_rng(3).normal(size=(3, 4, 5))


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(a, b, i, float(X[a, b, i])) for a in range(3) for b in range(4) for i in range(5)]
    return from_frame(spark.createDataFrame(rows, "a int, b int, i int, v double"), ["a", "b"], ["i"])


def array(c: Cube, *order):
    p = c.df.toPandas()
    p = p.sort_values(list(order)) if order else p
    return p["v"].to_numpy().reshape([p[k].nunique() for k in order])


@pytest.mark.parametrize(("how", "f"), [("sum", np.sum), ("mean", np.mean), ("std", np.std), ("var", np.var), ("min", np.min), ("max", np.max), ("prod", np.prod), ("norm", lambda x, axis: np.sqrt((x * x).sum(axis)))])
def test_reductions(cube, how, f):
    assert np.allclose(array(cube.reduce(how, "b"), "a", "i"), f(X, axis=1))
    assert np.allclose(array(cube.reduce_inner(how), "a", "b"), f(X, axis=2))


def test_batches_and_kept_dimension(cube):
    assert np.allclose(array(cube.mean("b", batch_size=2), "a", "i"), X.mean(1))
    out = cube.std("b", keep_dim=True)
    assert out.dims == ["a", "b"] and out.labels("b") == ["0-3"]
    with pytest.raises(ValueError):
        cube.reduce("var", "b", batch_size=2)
    with pytest.raises(ValueError):
        cube.reduce("no such", "b")


def test_selection(cube):
    assert np.allclose(array(cube.select(a=1), "b", "i"), X[1])
    assert cube.select(a=1).scalars == {"a": 1} and cube.select(a=1, drop=True).scalars == {}
    assert cube.select(b=[3, 1]).labels("b") == [3, 1]
    assert np.allclose(array(cube.iselect(b=-1), "a", "i"), X[:, -1])
    assert cube.select(a=1).select(a=1).dims == ["b"]
    with pytest.raises(KeyError):
        cube.select(a=1).select(a=2)
    cube.labels("a")
    with pytest.raises(KeyError):
        cube.select(a=9)
    assert np.allclose(array(cube.take("i", [4, 0]), "a", "b", "i"), X[:, :, [4, 0]])
    assert np.allclose(array(cube.take("i", 2), "a", "b"), X[:, :, 2])


def test_shape(cube):
    assert np.allclose(array(cube.expand("level", "i", size=3), "a", "b", "level"), X[:, :, :3])
    with pytest.raises(TypeError):
        cube.expand("level", "i")
    with pytest.raises(ValueError):
        cube.expand("level", "i", size=2, labels=["x"])
    s = cube.stack("b")
    assert s.inner == ["b", "i"] and s.dims == ["a"]
    again = s.expand("b", "b", size=4)
    assert np.allclose(array(again, "a", "b", "i"), X)
    assert np.allclose(array(cube.concatenate("b"), "a", "i"), X.reshape(3, 20))
    assert np.allclose(array(cube.flatten(), "b", "a", "i"), X.transpose(1, 0, 2))


def test_ragged_concatenation(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, [4.0, 5.0])], "s int, x array<double>")
    assert array(from_arrays(df, ["s"], "x").concatenate("s"), "i").tolist() == [1, 2, 3, 4, 5]


def test_join_broadcast_transform(spark, cube):
    one, two = cube.select(a=[0]), cube.select(a=[1])
    assert np.allclose(array(one.join(two, "a"), "a", "b", "i"), X[:2])
    new = one.join(two, "kind", ["x", "y"], match_coord_values=True)
    assert new.dims[0] == "kind" and np.allclose(array(new, "kind", "b", "i"), X[:2])
    with pytest.raises(ValueError):
        cube.select(b=[0, 1]).join(cube.select(b=[1, 2]), "a")
    wide = cube.select(b=0).broadcast(cube)
    assert array(wide, "a", "b", "i").shape == (3, 4, 5)
    t = cube.transform(lambda c, k: c.multiply(k), [2, 3], "k")
    assert np.allclose(array(t, "k", "a", "b", "i"), np.stack([2 * X, 3 * X]))
    assert np.allclose(array(cube.transform_values(lambda v, k: v * k, [2, 3], "k"), "k", "a", "b", "i"), np.stack([2 * X, 3 * X]))
    assert cube.transform(lambda c, k: c.add(k), [1], "k").scalars == {"k": 1}
    with pytest.raises(ValueError):
        cube.transform(lambda c, k: c, [], "k")


def test_arithmetic_is_by_position(cube):
    low, high = cube.select(b=[0, 1]), cube.select(b=[2, 3])
    assert np.allclose(array(low.subtract(high), "a", "b", "i"), X[:, :2] - X[:, 2:])
    assert low.subtract(high, align="label").df.count() == 0
    with pytest.raises(ValueError):
        low.add(cube)
    assert np.allclose(array(cube.power(2).divide(4), "a", "b", "i"), X**2 / 4)
    masked = low.mask(low, ">", 0.0, -1.0)
    assert np.allclose(array(masked, "a", "b", "i"), np.where(X[:, :2] > 0, -1, X[:, :2]))
    with pytest.raises(ValueError):
        low.mask(low, "!", 0.0)


def test_ieee(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 0.0), (2, -1.0, 0.0), (3, 1.0, 4.0), (4, None, 1.0)], "k int, a double, b double")
    got = [r[0] for r in df.orderBy("k").select(fn.divide(F.col("a"), F.col("b"))).collect()]
    assert got[0] == np.inf and np.isnan(got[1]) and got[2] == -np.inf and got[3] == 0.25 and got[4] is None
    low = spark.createDataFrame([(1, 1.0), (1, float("nan")), (2, 3.0)], "k int, v double").groupBy("k").agg(fn.reduction("min")(F.col("v")).alias("v"))
    got = {r.k: r.v for r in low.collect()}
    assert np.isnan(got[1]) and got[2] == 3.0


def test_python_functions(cube):
    assert np.allclose(array(cube.map_arrays(np.cumsum), "a", "b", "i"), X.cumsum(2))
    assert np.allclose(array(cube.reduce_arrays(lambda x: np.median(x, 0), "b", block=2), "a", "i"), np.median(X, 1))
    y = cube.yields([lambda v: v, lambda v: -v], "s", ["p", "n"])
    assert y.dims[-1] == "s" and np.allclose(array(y.select(s="n"), "a", "b", "i"), -X)
    with pytest.raises(ValueError):
        cube.yields([lambda v: v], "s", ["p", "n"])


def test_namespaces_and_registry(cube):
    class Space(Cube):
        def doubled(self):
            return self.map(lambda v: 2 * v)

    Cube.register("space", Space)
    try:
        assert np.allclose(array(cube.space.doubled(), "a", "b", "i"), 2 * X)
        with pytest.raises(ValueError):
            Cube.register("space", Space)
        with pytest.raises(TypeError):
            Cube.register("other", dict)
    finally:
        Cube._spaces.clear()
    fn.register("range", lambda v: F.max(v) - F.min(v))
    assert np.allclose(array(cube.reduce("range", "b"), "a", "i"), np.ptp(X, 1))


def test_sources(spark, tmp_path, cube):
    cube.write(str(tmp_path / "c"), by=["a"])
    assert spark.read.parquet(str(tmp_path / "c")).count() == 60
    with pytest.raises(ValueError):
        from_parts([cube.df], {"k": [1, 2]})
    with pytest.raises(ValueError):
        Cube(cube.df, ["none"])
    g = generated(spark, {"m": [1, 2]}, 5, seed=1)
    assert g.df.count() == 10 and g.df.collect() == generated(spark, {"m": [1, 2]}, 5, seed=1).df.collect()


def test_ensemble(cube):
    w = ensemble.window_operation(cube, "mean", {"x": [0, 1], "y": [1, 2, 3]}, "b")
    assert np.allclose(array(w, "a", "window", "i"), np.stack([X[:, :2].mean(1), X[:, 1:].mean(1)], 1))
    p = ensemble.threshold_prob(cube, ">=", 0.0, "a")
    assert np.allclose(array(p, "b", "i"), (X >= 0).mean(0) * 100)
    assert abs(sum(ensemble.efi_weights()) - np.pi) < 1e-9
    # A forecast above all of the climatology has EFI 1 but for the discretisation, one equal to it about 0.
    clim = ensemble.climatology(cube, ["b"])
    high = ensemble.extreme(cube.add(100), clim, "b").df.agg(F.min("efi")).first()[0]
    assert 0.95 < high <= 1.0


def plan(spark, edges, payload=None):
    names = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(n, (payload or {}).get(n, n)) for n in names], "name string, payload string")
    return Plan(nodes, spark.createDataFrame([(a, "0", b, f"in{k}") for k, (a, b) in enumerate(edges)], "src string, output string, dst string, input string"))


def test_graph(spark):
    p = plan(spark, [("v0", "v1"), ("v1", "v2"), ("v3", "v1"), ("v4", "v5"), ("v4", "v6")])
    assert {(r.name, r.component) for r in p.components().collect()} == {("v0", "v0"), ("v1", "v0"), ("v2", "v0"), ("v3", "v0"), ("v4", "v4"), ("v5", "v4"), ("v6", "v4")}
    assert {r.name for r in p.sinks().collect()} == {"v2", "v5", "v6"}
    assert {r.name: r.layer for r in p.layers().collect()} == {"v0": 0, "v3": 0, "v4": 0, "v1": 1, "v5": 1, "v6": 1, "v2": 2}
    assert not p.has_cycle() and plan(spark, [("a", "b"), ("b", "a")]).has_cycle()
    ncd = {(r.a, r.b): r.d for r in p.nearest_common_descendant().collect()}
    assert ncd == {("v0", "v1"): 1, ("v0", "v2"): 2, ("v1", "v2"): 1, ("v0", "v3"): 1, ("v1", "v3"): 1, ("v2", "v3"): 2, ("v4", "v5"): 1, ("v4", "v6"): 1}
    again = Plan.from_json(spark, p.to_json())
    assert sorted(again.edges.collect()) == sorted(p.edges.collect()) and '"v0" -> "v1"' in p.to_dot()
    both = Plan.namespaced(x=p, y=p)
    assert both.nodes.count() == 14 and both.predecessors("x.v1").count() == 2
    inside, cut = p.split(F.col("name").isin("v0", "v1"))
    assert inside.edges.count() == 3 and {(r.src, r.dst) for r in cut.collect()} == {("v1", "v2"), ("v3", "v1")}


def test_deduplication_and_costs(spark):
    diamond = [("s", "a"), ("s", "b"), ("a", "t"), ("b", "t")]
    p = plan(spark, diamond, {"a": "f", "b": "f"})
    p.edges = p.edges.withColumn("input", F.when(F.col("dst") == "t", F.col("src")).otherwise("x"))
    d = p.deduplicated()
    assert {r.name for r in d.nodes.collect()} == {"s", "a", "t"} and d.edges.count() == 3
    costs = p.nodes.select("name", F.lit(1.0).alias("cost"))
    assert {r.name: r.total for r in p.accumulated(costs).collect()} == {"s": 1, "a": 2, "b": 2, "t": 5}
    assert {r.name: r.total for r in p.accumulated(costs, once=True).collect()} == {"s": 1, "a": 2, "b": 2, "t": 4}


def test_jobs(spark, tmp_path):
    def source(n: int) -> object:
        return spark.range(n)

    def twice(rows: object, k: int = 2) -> object:
        return rows.select((F.col("id") * k).alias("id"))

    good = JobBuilder().with_step("s", Step.of(source).with_values(n=3)).with_step("t", twice).with_edge("s", "t", "rows")
    job, errors = good.build()
    assert not errors and [r.id for r in job.run()["t"].collect()] == [0, 2, 4]
    service = JobService(spark)
    name = service.submit(job, "t", str(tmp_path / "out"))
    assert service.result(name).count() == 3 and service.progress() == {name: "100.00"}
    assert service.progress(["none"])["none"].startswith("error")
    service.shutdown()
    _, errors = JobBuilder().with_step("s", Step.of(source).with_values(n="x")).with_step("t", twice).with_edge("q", "t", "rows").build()
    assert len(errors) == 2
    _, errors = JobBuilder().with_step("s", source).build()
    assert errors == ["s lacks n"]
    _, errors = JobBuilder().with_step("t", twice).with_edge("t", "t", "rows").build()
    assert errors == ["the steps form a cycle"]


def test_traces(spark):
    lines = [f"x mark #action=task_{a};task=t;worker=w;at={10 * k * k}" for k, a in enumerate(traces.TASK_ACTIONS)]
    lines += ["x mark #action=transmit_planned;dataset=d;target=h;source=g;mode=remote;at=1", "x mark #action=transmit_completed;dataset=d;target=h;at=9", "x trace #wait=5", "x trace #wait=7", "other"]
    log = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = traces.marks(log, "mark")
    d = traces.task_durations(rows.where("kind = 'task'")).first()
    assert d.total_e2e == 360 and d.task_load == 50 and d.comm2ctrl == 110
    t = traces.transmit_durations(rows.where("kind = 'transmit'")).first()
    assert (t["mode"], t["source"], t["total"]) == ("remote", "g", 8)
    m = {r.kind: r.duration_ns_sum for r in traces.microtrace_stats(traces.microtraces(log, "trace"), ["wait", "load"]).collect()}
    assert m == {"wait": 12, "load": 0}


def test_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:10' + make_interval(0,0,0,0,0,id,0) ts, id % 2 k, double(id) v from range(10)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream, "ts", "5 minutes", "sum", "v", ["k"], late="1 minute").writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed(rows, "ts", "5 minutes", "sum", "v", ["k"]).collect()))


def test_select_of_a_label_that_no_cell_has(spark):
    """An error whether the labels are known or not."""
    df = spark.createDataFrame([(a, b, float(a * b)) for a in range(3) for b in range(2)], "x long, y long, v double")
    for coords in (None, {"x": [0, 1, 2]}):
        cube = Cube(df, ["x", "y"], coords=coords)
        assert cube.select(x=[0, 2]).df.count() == 4 and cube.select(x=1).dims == ["y"]
        for bad in (7, [0, 7]):
            with pytest.raises(KeyError):
                cube.select(x=bad)


def test_concatenate_in_short_runs(spark, monkeypatch):
    """Elements meet the offset of their array in runs; arrays of unequal length follow each other."""
    from fieldcube import cube as module

    monkeypatch.setattr(module, "RUN", 3)
    rows = [(c, s, i, float(100 * c + 10 * s + i)) for c in range(2) for s in range(3) for i in range(4 + 3 * s)]
    df = spark.createDataFrame(rows, "c long, s long, i long, v double")
    got = sorted((r.c, r.i, r.v) for r in Cube(df, ["c", "s"], ["i"]).concatenate("s").df.collect())
    want = [(c, k, v) for c in range(2) for k, v in enumerate(r[3] for r in rows if r[0] == c)]
    assert got == want


def test_set_metadata(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, None)], "x long, meta map<string,string>")
    got = {r.x: r.meta for r in Cube(df, ["x"], values=["meta"]).set_metadata("meta", {"b": 3}, c=F.col("x") + 1, a=None).df.collect()}
    assert got == {1: {"b": "3", "c": "2"}, 2: {"b": "3", "c": "3"}}
    new = Cube(df.select("x").withColumn("v", F.lit(1.0)), ["x"]).set_metadata("info", unit="K")
    assert new.values == ["v", "info"] and new.df.first().info == {"unit": "K"}


def test_functions_and_parameters_for_each_cell(cube):
    params = [[float(10 * a + b) for b in range(4)] for a in range(3)]
    assert np.allclose(array(cube.map_each(lambda v, k: v * k, ["a", "b"], params), "a", "b", "i"), X * np.array(params)[..., None])
    plus, minus = (lambda v: v + 1), (lambda v: -v)
    got = array(cube.map_cells([[plus, minus, minus, plus]] * 3, ["a", "b"]), "a", "b", "i")
    assert np.allclose(got[:, [0, 3]], X[:, [0, 3]] + 1) and np.allclose(got[:, [1, 2]], -X[:, [1, 2]])
    assert np.allclose(array(cube.map_cells([plus, minus, plus], "a"), "a", "b", "i")[1], -X[1])
    for bad in ([[plus] * 4] * 2, [[plus] * 3] * 3):
        with pytest.raises(ValueError):
            cube.map_cells(bad, ["a", "b"])


def test_parameters_from_a_cube(spark, cube, monkeypatch):
    """More cells than may come to the driver; null labels; no parameter or two of them are errors."""
    from fieldcube import cube as module

    monkeypatch.setattr(module, "LABEL_LIMIT", 2)
    rows = [(b, a, float(10 * a + b)) for a in range(3) for b in range(4)]
    params = Cube(spark.createDataFrame(rows, "b long, a long, k double"), ["b", "a"], [], ["k"])
    got = cube.map_each(lambda v, k: v * k, ["a", "b"], params)
    assert got.df.columns == ["a", "b", "i", "v"] and np.allclose(array(got, "a", "b", "i"), X * (10 * np.arange(3)[:, None] + np.arange(4))[..., None])
    one = Cube(params.df.where("b = 0").drop("b"), ["a"], [], ["k"])
    assert np.allclose(array(cube.map_each(lambda v, k: v + k, "a", one), "a", "b", "i"), X + 10 * np.arange(3)[:, None, None])
    nulls = Cube(spark.createDataFrame([(None, 1.0), (1, 2.0)], "a long, v double"), ["a"])
    ks = Cube(spark.createDataFrame([(1, None), (None, 5.0)], "a long, k double"), ["a"], [], ["k"])
    assert {(r.a, r.v) for r in nulls.map_each(lambda v, k: v * k, "a", ks).df.collect()} == {(None, 5.0), (1, None)}
    with pytest.raises(Exception, match="no entry for the cell 2 3"):
        cube.map_each(lambda v, k: v * k, ["a", "b"], params._new(params.df.where("a < 2 or b < 3"))).df.collect()
    with pytest.raises(ValueError, match="several entries"):
        cube.map_each(lambda v, k: v * k, ["a", "b"], params._new(params.df.union(params.df.limit(1))))
    for bad in (one, cube):
        with pytest.raises(ValueError, match="one value for each cell"):
            cube.map_each(lambda v, k: v * k, ["a", "b"], bad)


def test_several_results(cube):
    def both(x):
        yield x
        yield x[::-1]

    y = cube.yields_arrays(both, "s", ["p", "n"])
    assert y.dims == ["a", "b", "s"] and np.allclose(array(y.select(s="n"), "a", "b", "i"), X[..., ::-1])
    with pytest.raises(Exception, match="2 results for 3 labels"):
        cube.yields_arrays(both, "s", [1, 2, 3]).df.collect()
    r = cube.reduce_yields(["min", lambda v: F.max(v)], "s", ["p", "n"], "b")
    assert r.dims == ["a", "s"] and np.allclose(array(r.select(s="p"), "a", "i"), X.min(1)) and np.allclose(array(r.select(s="n"), "a", "i"), X.max(1))
    r = cube.reduce_arrays(lambda x: (x.sum(0), np.median(x, 0)), "b", block=2, yields=("s", ["p", "n"]))
    assert np.allclose(array(r.select(s="p"), "a", "i"), X.sum(1)) and np.allclose(array(r.select(s="n"), "a", "i"), np.median(X, 1))
    with pytest.raises(ValueError):
        cube.reduce_yields(["min"], "s", ["p", "n"], "b")


def test_take_by_label_and_expand_beyond_the_end(spark, cube):
    named = from_frame(spark.createDataFrame([(k, x, float(k)) for k in range(2) for x in "pqr"], "k int, x string, v double"), ["k"], ["x"])
    assert {r.x for r in named.take("x", ["r", "p"], method="sel").df.collect()} == {"p", "r"}
    one = named.take("x", "q", method="sel", drop=False)
    assert one.inner == [] and one.scalars == {"x": "q"} and one.df.count() == 2
    for bad in ("z", ["p", "z"]):
        with pytest.raises(KeyError):
            named.take("x", bad, method="sel")
    with pytest.raises(ValueError):
        named.take("x", "q", method="near")
    with pytest.raises(ValueError):
        cube.expand("level", "i", size=6)
    assert cube.expand("level", "i", size=5).df.count() == 60


def test_plans_as_dictionaries(spark):
    for p in (samples.linear(spark, 2), samples.multi(spark, 2, 4, 2), samples.empty(spark)):
        data = p.serialise()
        assert Plan.deserialise(spark, data).equals(p)
    multi = samples.multi(spark, 5, 3, 2).serialise()
    assert multi["process-1"]["inputs"] == {"input1": ["process-0", "output0"], "input2": ["process-0", "output2"]}
    assert multi["process-2"] == {"inputs": {"input1": ["process-0", "output1"], "input2": "reader-2"}, "outputs": ["output0", "output1"]}
    assert not samples.linear(spark, 2).equals(samples.linear(spark, 3))
    with pytest.raises(KeyError):
        Plan.deserialise(spark, {"a": {"inputs": {"x": "none"}}})
    p = samples.linear(spark)
    assert p.get_node("reader").payload is None
    for f in (p.get_node, p.predecessors, p.successors):
        with pytest.raises(KeyError):
            f("none")


def test_sample_plans(spark):
    def size(p):
        return p.nodes.count(), p.edges.count(), p.sources().count(), p.sinks().count()

    assert size(samples.empty(spark)) == (0, 0, 0, 0)
    assert size(samples.linear(spark, 5)) == (7, 6, 1, 1)
    assert size(samples.disconnected(spark, 5, 1)) == (15, 10, 5, 5) and size(samples.disconnected(spark, 2, 3)) == (10, 8, 2, 2)
    assert size(samples.simple(spark, 5, 3)) == (11, 18, 5, 3)
    assert size(samples.multi(spark, 5, 3, 2)) == (10, 5 + 2 + 2 + 4, 5, 2)
    assert size(samples.comb(spark, 5, 0)) == (10, 9, 5, 1) and size(samples.comb(spark, 3, 2)) == (12, 11, 3, 1)
    assert {r.name: r.component for r in samples.disconnected(spark, 2, 1).components().collect()}["writer-1"] == "process-1"


def test_values(spark):
    """Of two ways down the shorter counts; each component has a depth of its own."""
    p = plan(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("x", "y")])
    assert {r.name: r.value for r in p.values().collect()} == {"a": 3, "b": 2, "c": 3, "d": 4, "e": 4, "x": 1, "y": 2}


def test_filled_keeps_rows_of_null_keys(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (None, 1, "c"), (None, 2, None), (2, 1, None)], "k int, at int, m string")
    got = sorted(((r.k or 0, r.at, r.m) for r in traces.filled(rows, ["m"], ["k"]).collect()))
    assert got == [(0, 1, "c"), (0, 2, "c"), (1, 1, "b"), (1, 2, "b"), (1, 3, "b"), (2, 1, None)]
