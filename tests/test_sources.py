"""Readers, stores, the façade and streams, on files of a temporary folder."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quernstone import schema as S
from quernstone.api import Engine
from quernstone.config import SplitterConfig, WebConfig
from quernstone.operators import export, models
from quernstone.sources import readers
from quernstone.sources.store import StorageContext, Table
from quernstone.streaming import ingestion


def texts(df):
    return sorted(r["text"] for r in df.collect())


def test_directories(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"a.txt": "one", "b.md": "two", "c": "three", "d.TXT": "four", "sub/e.txt": "five"}.items():
        (tmp_path / name).write_text(body)
    assert texts(readers.directory(spark, str(tmp_path), True, ["txt"])) == ["five", "one"]
    assert texts(readers.directory(spark, str(tmp_path), False)) == ["four", "one", "three", "two"]
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="MALFORMED_CHARACTER_CODING"):
        readers.directory(spark, str(tmp_path), False, ["txt"]).collect()


def test_json_texts_and_extras(spark, tmp_path):
    values = [{"text": "t", "content": "c", "k": 1}, {"content": "c2", "text": 5, "a": [1]}, "bare", 7, {"x": None}]
    (tmp_path / "f.json").write_text(json.dumps(values))
    got = {r["text"]: r["metadata"]["extra"] for r in readers.json_file(spark, str(tmp_path / "f.json")).collect()}
    assert got == {"t": {"k": "1"}, "c2": {"a": "[1]"}, "bare": None, "7": None, '{"x":null}': {"x": "null"}}
    (tmp_path / "one.json").write_text('{"text": "single"}')
    assert texts(readers.json_file(spark, str(tmp_path / "one.json"))) == ["single"]


def test_markdown_sections(spark, tmp_path):
    (tmp_path / "m.md").write_text("pre\n# A\nbody\n#tag\n```\n# code\n```\n#  \n")
    got = {r["text"]: r["metadata"]["extra"]["header"] for r in readers.markdown(spark, str(tmp_path / "m.md")).collect()}
    assert got == {"pre": '""', "# A\nbody": '"A"', "#tag\n```": '"tag"', "# code\n```": '"code"', "#  \n": '""'}


def test_pdf_pages_by_any_extractor(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"p1|  |p3")
    got = readers.pdf(spark, str(tmp_path), lambda c: c.decode().split("|")).collect()
    assert sorted((r["text"], r["metadata"]["extra"]["page_label"]) for r in got) == [("p1", '"1"'), ("p3", '"3"')]


def test_web_pages(spark):
    html = "<html><head><title>T</title></head><body><div class='a b'><h2>Hi</h2><p>one <b>two</b></p><script>no</script></div><p>later</p></body></html>"
    assert readers.to_markdown(html, "div.b") == "## Hi\n\none **two**"
    assert readers.to_markdown(html, "#none") == ""
    got = readers.web(spark, ["http://a/", "http://b/"], config=WebConfig(0, 0, 2), get=lambda u, c: f"<body>{u}</body>").collect()
    assert sorted((r["text"], r["metadata"]["url"]) for r in got) == [("http://a/", "http://a/"), ("http://b/", "http://b/")]


def test_exam_questions(spark, tmp_path):
    q = {"question": "Q", "options": {"A": "x", "B": "y"}, "explanation": "E"}
    (tmp_path / "a.json").write_text(json.dumps([q]))
    (tmp_path / "b.json").write_text(json.dumps(q | {"options": ["z"]}) + "\nbroken {\n")
    assert texts(readers.exam(spark, str(tmp_path))) == ["QUESTION\nQ\nOPTIONS\nx\ny\nEXPLANATION\nE", "QUESTION\nQ\nOPTIONS\nz\nEXPLANATION\nE"]


def test_triplets_as_lines_of_json(spark, tmp_path):
    df = spark.createDataFrame([("q", "p", ["a", "b"], [1], {"m": "1"})], export.SELECTOR_TRIPLET)
    export.to_jsonl(df, str(tmp_path / "t"))
    export.to_jsonl(df, str(tmp_path / "t"), mode="append")
    assert [tuple(r) for r in export.from_jsonl(spark, str(tmp_path / "t")).collect()] == [tuple(df.first())] * 2
    (tmp_path / "bad.jsonl").write_text('{"query": "q"}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED"):
        export.from_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_a_table_flips_versions_and_survives_a_failed_write(spark, tmp_path):
    t = Table(spark, str(tmp_path), "t", spark.range(0).schema, ("id",))
    assert t.read().count() == 0
    t.write(spark.range(2))
    t.write(t.read().unionByName(spark.range(5, 6)))
    assert sorted(r[0] for r in t.read().collect()) == [0, 1, 5]
    with pytest.raises(Exception, match="boom"):
        t.write(spark.range(1).select(F.raise_error(F.lit("boom")).cast("long").alias("id")))
    assert t.read().count() == 3
    assert t.vacuum() == 2 and t.read().count() == 3


def nodes_of(spark, *texts, genre="g"):
    return S.text_nodes(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"), S.metadata(genre=F.lit(genre)))


def test_stores_round_trip(spark, tmp_path):
    context = StorageContext.open(spark, str(tmp_path), 2)
    nodes = nodes_of(spark, "a", "b")
    context.docs.add(nodes)
    context.docs.add(nodes_of(spark, "a", genre="other"), allow_update=False)
    again = StorageContext.open(spark, str(tmp_path))
    assert {r["metadata"]["genre"] for r in again.docs.nodes.read().collect()} == {"g"}
    a = nodes.where("text = 'a'").select("node_id")
    key = a.first()[0]
    assert again.docs.exists(key) and again.docs.get(a).first()["text"] == "a"
    vectors = nodes.select("node_id", F.when(F.col("text") == "a", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0))).cast("array<float>").alias("embedding"))
    again.vectors.dim = 2
    again.vectors.add(vectors)
    assert [r["node_id"] for r in again.vectors.read().collect()] == [key]
    with pytest.raises(ValueError):
        StorageContext.open(spark, str(tmp_path), 3)
    again.docs.delete(a)
    again.docs.delete(a)
    assert not again.docs.exists(key) and again.docs.hashes.read().count() == 1
    index = spark.createDataFrame([("i", "s", {})], "index_id string, summary string, extra map<string,string>")
    again.indexes.put(index, spark.createDataFrame([("i", "n", "d")], "index_id string, node_id string, doc_id string"))
    assert again.indexes.get("i")["summary"] == "s"
    with pytest.raises(KeyError):
        again.indexes.get("none")
    refs = spark.createDataFrame([("d", ["n"], {})], "doc_id string, node_ids array<string>, metadata map<string,string>")
    again.docs.set_ref_docs(refs)
    again.docs.delete_ref_docs(refs.select("doc_id"))
    assert again.docs.refs.read().count() == 0
    again.export_documents(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_the_engine_ingests_once_retrieves_and_answers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/rust.md").write_text("Rust is a systems language that compiles to machine code.")
    (tmp_path / "in/tea.txt").write_text("Green tea is brewed with water below boiling.")
    engine = Engine(spark, str(tmp_path / "store"), models.HashedBag(64), SplitterConfig(64, 8))
    assert engine.ping() == "pong" and engine.ingest(str(tmp_path / "in")) == 2 and engine.ingest(str(tmp_path / "in")) == 0
    assert "Rust" in engine.query("systems language that compiles", 1)[0][0]
    again = Engine(spark, str(tmp_path / "store"), models.HashedBag(64))
    assert "tea" in again.query("green tea water", 1)[0][0]
    assert "Rust" in again.ask("which language compiles?", models.Echo(), 2)
    (tmp_path / "in/late.txt").write_text("A late file on gardens. " * 30)
    assert again.ingest(str(tmp_path / "in")) == 1
    assert "gardens" in again.query("late file on gardens", 1)[0][0] and "Rust" in again.query("systems language that compiles", 1)[0][0]
    sources = again.context.edges.read().where("rel = 'SOURCE'").select("dst_id").distinct().count()
    assert sources == 3 and again.context.indexes.members.read().select("doc_id").distinct().count() == 3


def test_a_tree_is_kept_and_restored(spark, tmp_path):
    from quernstone.operators import tree
    from quernstone.sources.scratch import stored

    leaves = spark.createDataFrame([(f"n{i}", "k" if i < 6 else "l", i, f"capital {i}") for i in range(8)], "node_id string, key string, ord int, text string")
    nodes, edges = tree.build(leaves, lambda p: F.concat(F.lit("summary "), F.length(p).cast("string")), stored)
    name = tree.save(nodes, edges, StorageContext.open(spark, str(tmp_path)))
    assert name == tree.save(nodes, edges, StorageContext.open(spark, str(tmp_path))) and name.startswith("hidx_") and len(name) == 17
    roots, kept = tree.restore(StorageContext.open(spark, str(tmp_path)), name)
    assert roots.count() == 2 and kept.count() == 11  # a finished key goes up with the others, as a chain
    start = roots.select(F.lit(0).alias("query_id"), "node_id")
    assert sorted(r["node_id"] for r in tree.descend(start, kept, tree.every_child, 5, stored).collect()) == [f"n{i}" for i in range(8)]
    with pytest.raises(KeyError):
        tree.restore(StorageContext.open(spark, str(tmp_path)), "hidx_none")


def test_a_stream_of_documents_is_ingested_once(spark, tmp_path):
    nodes = nodes_of(spark, "a", "b", "c")
    nodes.write.parquet(str(tmp_path / "in"))
    context = StorageContext.open(spark, str(tmp_path / "store"))
    for _ in range(2):
        stream = spark.readStream.schema(S.NODES).parquet(str(tmp_path / "in"))
        ingestion.start(stream, context, [], str(tmp_path / "checkpoint")).awaitTermination()
        assert context.docs.nodes.read().count() == 3
    nodes_of(spark, "c", "d").write.mode("append").parquet(str(tmp_path / "in"))
    ingestion.start(spark.readStream.schema(S.NODES).parquet(str(tmp_path / "in")), context, [], str(tmp_path / "checkpoint")).awaitTermination()
    assert texts(context.docs.nodes.read()) == ["a", "b", "c", "d"]


def test_copies_within_the_watermark_go(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2024-01-01 00:00:00'), ('a', TIMESTAMP'2024-01-01 00:10:00'), ('b', TIMESTAMP'2024-01-01 00:20:00') AS t(text, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingestion.unseen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "text", "ts")
    query = stream.writeStream.format("memory").queryName("unseen_copies").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["text"] for r in spark.table("unseen_copies").collect()) == ["a", "b"]
