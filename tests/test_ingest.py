"""Ingest from files, the façade, and streams."""

import pytest
from pyspark.sql import functions as F

from codelake.engine import Engine
from codelake.operators import ops
from codelake.sources import ingest
from codelake.streaming.limits import admission_stream, offered_load_stream, rate_decision_stream
from tests.test_operators import requests

PYTHON = '''import os
from typing import List
import utils.helpers


def calculate_total(items):
    total = 0
    for i in items:
        total += i
    return total


class ShoppingCart:
    def __init__(self):
        self.items = []
        self.x = 1
        self.y = 2

    def get_total(self):
        a = 1
        b = 2
        return calculate_total(self.items)
'''
SCRIPT = "import {a} from './lib';\nfunction calculateTotal(items) {\n  // class Fake {\n  let s = 'function no() {';\n  return 1;\n}\nclass CartBox {\n  addItem(x) {\n    return 1;\n  }\n}\n"
USER = "def checkout_all(cart):\n    x = 1\n    y = 2\n    return calculate_total(cart)\n"


@pytest.fixture
def folder(tmp_path):
    for name, text in {"cart.py": PYTHON, "cart.js": SCRIPT, "pkg/user.py": USER, "node_modules/x.py": USER, "bad.py": "def (", "notes.txt": "x"}.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "repo")


def test_captures(spark, folder):
    files = ingest.scan_files(spark, folder, "r")
    assert {r.file for r in files.collect()} == {"cart.py", "cart.js", "pkg/user.py", "bad.py"}
    found = {(r.file, r.name, r.start_line, r.end_line) for r in ingest.captures(files).collect()}
    assert ("cart.py", "calculate_total", 5, 9) in found and ("cart.py", "get_total", 18, 21) in found and ("cart.py", "ShoppingCart", 12, 21) in found
    assert ("cart.js", "calculateTotal", 1, 5) in found and {n for f, n, *_ in found if f == "cart.js"} == {"calculateTotal", "CartBox", "addItem"}


def test_labels_and_names(spark):
    rows = [("function_definition", "item", "Function"), ("x", "@definition.resource", "Resource"), ("my_method_x", "a", "Function"), ("struct", "a", "Class"), ("comment", "a", None)]
    got = spark.createDataFrame(rows, "n string, c string, want string").select(ingest.label(F.col("n"), F.col("c")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    assert spark.range(1).select(ingest.clean_name(F.lit("\"'a'\""))).first()[0] == "a"


def test_imports(spark):
    files = spark.createDataFrame([("r", "a.py", "python", PYTHON), ("r", "a.js", "javascript", SCRIPT), ("r", "a.go", "go", "import x")], "repo_id string, file string, language string, text string")
    assert {(r.file, r["import"]) for r in ingest.imports(files).collect()} == {("a.py", "os"), ("a.py", "typing"), ("a.py", "utils.helpers"), ("a.js", "./lib")}


def test_engine(spark, folder, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/lake")
    counts = engine.ingest(folder, "r")
    assert counts["entities"] >= 7 and counts["calls"] >= 1
    assert {(r.src_uid, r.dst_uid) for r in engine.calls.collect()} >= {("r::pkg/user.py::checkout_all", "r::cart.py::calculate_total")}
    hits = engine.query("r", PYTHON[PYTHON.index("def calculate_total") : PYTHON.index("class Shop")], 2).collect()
    assert hits[0].name == "def calculate_total(items):" and hits[0].score > 0.99
    assert engine.stats("r").first().chunks == counts["chunks"]
    engine.ingest(folder, "s")
    engine.delete("r")
    assert {r.repo_id for r in spark.read.parquet(f"file://{tmp_path}/lake/entities").collect()} == {"s"}


def test_streams(spark, tmp_path):
    table = requests(spark, 120)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    for name, df in (("admitted", admission_stream(stream, 60, 3)), ("load", offered_load_stream(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120), f"{name} doesn't end"
        finally:
            q.stop()
    got = {r.id: r.admitted for r in spark.table("admitted").collect()}
    assert got == {r.id: r.admitted for r in ops.admissions(table, 60, 3, "installation", "endpoint").collect()}


def test_decisions_of_a_stream(spark, tmp_path):
    table = requests(spark, 200).withColumn("tokens", (1 + F.col("id") % 5).cast("long"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    limits = {"a": 11, "default": 6}
    q = rate_decision_stream(stream, 60, limits).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    got = {r.id: (r.admitted, r.used, r.retry_after, r.warned) for r in spark.table("decided").collect()}
    want = ops.rate_decisions(table, 60, F.when(F.col("endpoint") == "a", 11).otherwise(6), "installation", "endpoint")
    assert got == {r.id: (r.admitted, r.used, r.retry_after, r.warned) for r in want.collect()} and {v[0] for v in got.values()} == {True, False}
