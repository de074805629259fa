"""What the engine holds in memory at once."""

import pyarrow as pa
import pytest

from sluice.operators.runtime import execute_all, reports
from sluice.plans.graph import compile_graph
from sluice.plans.registry import stock_registry
from sluice.queries import QUERIES


def test_reports_leave_in_small_batches(spark, monkeypatch):
    """One batch of executions is many of reports: their size, not the number of rows, bounds what is in memory."""
    df = spark.createDataFrame([("0", None)], "execution_id string, facts string")
    caught, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: caught.append(f) or plain(self, f, schema))
    text = "x" * 1000
    g = compile_graph({"name": "g", "nodes": [{"id": "c", "routine": "vec/const@1", "params": {"value": text}}], "exports": [{"name": "x", "from": "c"}]}, stock_registry())
    assert reports(g, df).rows.schema == execute_all(g, df).schema
    ids = [str(i) for i in range(5000)]
    many = pa.RecordBatch.from_pydict({"execution_id": ids, "facts": pa.array([None] * len(ids), pa.string())})
    whole, rows = [list(f(iter([many]))) for f in caught]
    assert sum(b.nbytes for b in whole) > 8_000_000 and max(b.nbytes for b in [*whole, *rows]) < 4_500_000
    assert "facts" in whole[0].schema.names and "facts" not in rows[0].schema.names
    for got in (whole, rows):
        assert [x for b in got for x in b.column(0).to_pylist()] == ids
        assert {r["output"] for b in got for each in b.column("rows").to_pylist() for r in each} == {f'"{text}"'}


def test_light_reports_have_no_outputs(spark):
    df = spark.createDataFrame([("0", None)], "execution_id string, facts string")
    g = compile_graph({"name": "g", "nodes": [{"id": "c", "routine": "vec/const@1", "params": {"value": 1}}], "exports": [{"name": "x", "from": "c"}]}, stock_registry())
    assert [(r.key, r.outcome, r.output) for r in execute_all(g, df, detail="light").collect()] == [("c", "executed", None)]


def test_report_rows_are_never_joined_with_their_executions(spark, tmp_path):
    """Spark thinks reports as small as their executions: a join would broadcast all rows through the driver."""
    spark.range(3).selectExpr("id AS event_id", "CASE WHEN id < 2 THEN 'a' END AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    df = QUERIES["fanout_graph_body"](spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, df.collect()), key=str) == [("a", 6, 2), (None, 3, 1)]


def test_columns_that_executions_carry(spark):
    g = compile_graph({"name": "g", "nodes": [{"id": "c", "routine": "vec/const@1", "params": {"value": 1}}], "exports": [{"name": "x", "from": "c"}]}, stock_registry())
    df = spark.range(0, 500, 1, 1).selectExpr("CAST(id AS STRING) AS execution_id", "CASE WHEN id % 2 = 0 THEN '[]' END AS facts", "id * 2 AS `a.b`", "ARRAY(STRUCT(id AS i)) AS more")
    got = reports(g, df, carry=("a.b", "more"), most_batch=20_000)
    assert got.rows.select("`a.b`", "execution_id", "more.i", "outcome").orderBy("`a.b`").collect() == [(2 * i, str(i), [i], "executed" if i % 2 else "kernel_error") for i in range(500)]
    assert got.facts.select("`a.b`", "execution_id").orderBy("`a.b`").collect() == [(2 * i, str(i)) for i in range(1, 500, 2)]
    with pytest.raises(ValueError, match="key"):
        reports(g, df.withColumn("Key", df.execution_id), carry=("Key",))
