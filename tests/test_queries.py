import pytest
from conftest import DATA
from parity import same

from fieldcube.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck, ORACLES[name])


def test_windows_reach_the_last_step(spark):
    """Windows go as far as the table's steps, not to a listed one."""
    last = spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("max(vec_id div 10)").first()[0]
    for name in ("window_min", "window_probability"):
        assert {r.window for r in QUERIES[name](spark, DATA).select("window").distinct().collect()} == set(range(last // 5 + 1))


def test_a_parameter_for_each_of_many_cells(spark, duck, monkeypatch):
    """No list of the cells or steps in the driver: as many of them as there are vectors."""
    from fieldcube import cube

    monkeypatch.setattr(cube, "LABEL_LIMIT", 20)
    same(QUERIES["map_each_cell"](spark, DATA), duck, ORACLES["map_each_cell"])


def test_a_parameter_for_each_cell_of_odd_vectors(spark, tmp_path):
    """Repeated rows, a missing number, empty and missing vectors."""
    import duckdb

    con = duckdb.connect()
    rows = "(0, [1.5, 2.5]), (7, [3.0]), (7, [3.0]), (23, [-1.0, 4.0]), (NULL, [2.0]), (NULL, [8.0]), (31, []), (32, NULL), (200345, [0.25])"
    con.execute(f"CREATE TABLE embeddings AS SELECT a::BIGINT AS vec_id, b::FLOAT[] AS embedding FROM (VALUES {rows}) AS x(a, b)")
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    same(QUERIES["map_each_cell"](spark, str(tmp_path)), con, ORACLES["map_each_cell"])
