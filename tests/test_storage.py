"""Tables that are small in files and large in memory: joins shuffle them, work on them is dealt to tasks."""

from pyspark.sql import functions as F

from docloom import storage
from docloom.operators.graph import topo_levels
from docloom.operators.xml_paths import extract_xml
from docloom.sources.layers import split_layers
from docloom.storage import cut_wide

TEMPLATE = {"context": "/a", "rows": [{"schemaName": "s", "viewName": "v", "columns": [{"name": "b", "scalarType": "int", "val": "b"}]}]}


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_a_written_table_of_many_rows_is_not_broadcast(spark):
    many = cut_wide(spark.range(storage.WIDE_ROWS + 1), "many").filter("id % 2 = 0").select("id")
    few = cut_wide(spark.range(10), "few")
    left = spark.range(0, 50_000_000)
    assert "Broadcast" not in plan(left.join(many, "id"))
    assert "Broadcast" in plan(left.join(few, "id"))
    assert few.join(many, "id").count() == 5


def test_levels_of_many_nodes_are_found_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(storage, "WIDE_ROWS", 10)
    nodes = spark.range(60).select("id")
    good, issue = topo_levels(nodes, nodes.select("id", (F.col("id") - F.col("id") % 3 - 1).alias("dep")))
    assert {r.id: r.level for r in good.collect()} == {n: n // 3 for n in range(60)}
    assert issue.count() == 0
    assert "Broadcast" not in plan(issue)


def test_regular_modules_and_documents_are_dealt_to_several_tasks(spark):
    one = spark.range(0, 200, 1, 1)
    modules = one.select(F.format_string("/m/%d.json", "id").alias("module"), F.lit('{"top":{"format":"0.1","hosts":[{"name":"h"}]}}').alias("body"))
    components = split_layers(modules).components
    assert components.count() == 200 and len(components.inputFiles()) > 1
    docs = one.select(F.col("id").cast("string").alias("uri"), F.format_string("<a><b>%d</b></a>", "id").alias("content"))
    rows = extract_xml(docs, {"t": TEMPLATE}).views["s.v"]
    assert sorted(r.b for r in rows.collect()) == list(range(200)) and len(rows.inputFiles()) > 1
