"""Remote models by a local service, purged texts, splits by meaning, and tables that change."""

from __future__ import annotations

import base64
import json
import threading
import tracemalloc
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone import schema as S
from quernstone.functions import text as TX
from quernstone.operators import ann, chunking, models, search
from quernstone.plans import catalog, persisted
from quernstone.sources import scratch, store


@pytest.fixture(scope="module")
def service():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            if "contents" in asked:
                text = asked["contents"][0]["parts"][0]["text"]
                self.wfile.write(json.dumps({"candidates": [{"content": {"parts": [{"text": text.upper()}]}}]}).encode())
                return
            words = f"{asked['model']}: {asked['messages'][0]['content']} {self.headers.get('Authorization', '-')}".split(" ")
            if asked.get("stream"):
                for w in words:
                    self.wfile.write(f"data: {json.dumps({'choices': [{'delta': {'content': w + ' '}}]})}\n\n".encode())
                self.wfile.write(b'data: {"choices": [{"delta": {}}]}\n\ndata: [DONE]\n\n')
            else:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": " ".join(words)}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_chat_and_generation_services(spark, service):
    chat = models.ChatEndpoint(service, "m", "key")
    assert chat.complete("two words") == "m: two words Bearer key"
    assert list(chat.stream_complete("two words")) == ["m: ", "two ", "words ", "Bearer ", "key "]
    assert models.GenerateEndpoint(service).complete("abc") == "ABC" and list(models.GenerateEndpoint(service).stream_complete("abc")) == ["ABC"]
    assert list(models.Echo().stream_complete("x")) == ["x"]
    df = spark.createDataFrame([("p",), (None,)], "prompt string")
    assert {r["reply"] for r in models.complete(df, "prompt", models.GenerateEndpoint(service)).collect()} == {"P", None}


def nodes(spark, *texts):
    return S.text_nodes(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"), S.metadata(genre=F.lit("g")))


def test_purged_texts_are_read_from_tokens(spark, tmp_path):
    rows = S.cache_tokens(nodes(spark, "été 🙂", "b"), TX.ByteTokenizer())
    purged = S.purge(rows, F.col("text") != "b")
    read = lambda df, **more: {r["content"] for r in S.readable(df, **more).collect()}
    assert read(purged, tokenizer=TX.ByteTokenizer()) == {"été 🙂", "b"} and read(purged) == {None, "b"}
    for df, more in ((purged, {}), (purged.withColumn("tokens", F.lit(None).cast("array<int>")), {"tokenizer": TX.ByteTokenizer()})):
        with pytest.raises(Exception, match="purged"):
            S.readable(df, strict=True, **more).collect()
    ranks = tmp_path / "ranks"
    ranks.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)))
    tokenizer = TX.RankTokenizer(str(ranks), r"\w+|\W")
    assert read(S.purge(S.cache_tokens(nodes(spark, "é b"), tokenizer), F.lit(True)), tokenizer=tokenizer) == {"é b"}


def test_only_purged_nodes_are_decoded(spark):
    class Refusing(TX.RegexTokenizer):
        def decode(self, tokens):
            if len(tokens) != 1:
                raise ValueError("not purged")
            return "one"

    purged = S.purge(S.cache_tokens(nodes(spark, "one", "two words"), Refusing()), F.col("text") == "one")
    assert {r["content"] for r in S.readable(purged, Refusing()).collect()} == {"one", "two words"}


def test_a_batch_of_bytes_is_encoded_within_few_times_its_size():
    texts = pa.array(["", None, "été 🙂", *["word " * 2000] * 200, "z"])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    tokens = TX.encode_batch(texts, TX.ByteTokenizer())
    peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert peak < 8 * texts.nbytes
    assert tokens.to_pylist()[:3] == [[], None, list("été 🙂".encode())] and TX.decode_batch(tokens, TX.ByteTokenizer()).equals(texts)
    for cut in (slice(0, 0), slice(1, 3), slice(2, 204)):  # batches that don't begin where their buffers do
        part = TX.encode_batch(texts[cut], TX.ByteTokenizer())
        assert part.equals(tokens[cut]) and TX.decode_batch(tokens[cut], TX.ByteTokenizer()).equals(texts[cut])
    for bad in ([[256]], [[-1]], [[0xC3]], [[None]]):
        with pytest.raises((ValueError, pa.ArrowInvalid)):
            TX.decode_batch(pa.array(bad, pa.list_(pa.int32())), TX.ByteTokenizer())


def test_nodes_are_split_by_meaning(spark):
    text = "cats purr. cats sleep. cats purr. stones are hard. stones are grey. stones are hard."
    made = chunking.semantic_nodes(nodes(spark, text, "one."), lambda df: models.embed(df, "text", models.HashedBag(64)), percent=60.0).orderBy("ref_doc_id", "ord").collect()
    own = [r for r in made if r["ref_doc_id"] == S_ID(spark, text)]
    assert " ".join(r["text"] for r in own) == text and any(r["text"].startswith("stones") for r in own)
    assert all(r["metadata"]["genre"] == "g" for r in made) and [r["ord"] for r in own] == list(range(len(own)))


def S_ID(spark, text):
    return spark.range(1).select(S.node_id(F.lit(text)).alias("i")).first()["i"]


def test_tables_merge_changes_and_fold_them(spark, tmp_path):
    kind = spark.createDataFrame([], "id long, v string").schema
    t = store.Table(spark, str(tmp_path), "t", kind, ("id",))
    rows = lambda *x: spark.createDataFrame(list(x), kind)
    has = lambda: dict(tuple(r) for r in t.read().collect())
    t.upsert(rows((1, "a"), (2, "b")))
    t.upsert(rows((2, "c"), (3, "d")))
    t.upsert(rows((3, "no"), (4, "e")), allow_update=False)
    assert has() == {1: "a", 2: "c", 3: "d", 4: "e"}
    t.delete(rows((1, None), (9, None)))
    t.upsert(rows((1, "back")))
    t.replace(rows((5, "c")), ["v"])  # drops what else has this value
    assert has() == {1: "back", 3: "d", 4: "e", 5: "c"}
    sizes = [len(t.state())]
    for i in range(store.MOST_CHANGES + 2):
        t.upsert(rows((10 + i, "x")))
        sizes.append(len(t.state()))
    assert max(sizes) <= store.MOST_CHANGES + 1 and min(sizes) == 1  # folded into a base
    assert len(has()) == 4 + store.MOST_CHANGES + 2
    assert t.vacuum() > 0 and len(has()) == 4 + store.MOST_CHANGES + 2


def test_stored_tables_can_be_dropped(spark):
    kept = scratch.stored(spark.range(3), "kept")
    assert kept.count() == 3
    scratch.drop(kept, spark.range(1))
    with pytest.raises(Exception, match="exist|FILE_NOT_EXIST|Path"):
        kept.collect()


def test_a_kept_index_is_opened_added_to_and_searched(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 16))
    df = spark.createDataFrame([(f"v{i:03d}", [float(a) for a in v]) for i, v in enumerate(x)] + [("null", None)], "vec_id string, embedding array<double>").repartition(3)
    ann.VectorIndex.build(df.where("vec_id < 'v600'"), str(tmp_path), cells=24)
    index = ann.VectorIndex(spark, str(tmp_path))
    index.add(df.where("vec_id >= 'v600'"))
    asked = df.where("vec_id like 'v%0'").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = {(r["query_id"], r["vec_id"]) for r in search.top_k_batch(df, asked, 5).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in index.top_k(asked, 5, 6, block=40).collect()}
    assert len(got) == len(exact) == 450 and len(exact & got) >= 0.9 * len(exact)
    every = {(r["query_id"], r["vec_id"]) for r in index.top_k(asked, 5, 24).collect()}
    assert every == exact  # all cells probed
    one = index.top_k(asked.limit(1), 5, 2)
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().executedPlan().toString()


def test_an_index_takes_many_queries_in_few_passes(spark, tmp_path):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    index = ann.VectorIndex.build(df, str(tmp_path), cells=6)
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    spark.sparkContext.setJobGroup("few", "few")
    try:
        few = {tuple(r) for r in index.top_k(asked, 5, 3, digits=6, block=10).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert few == {tuple(r) for r in index.top_k(asked, 5, 3, digits=6).collect()} == {tuple(r) for r in index.top_k(asked, 5, 3, digits=6, block=10, page=70).collect()}
    assert len(few) == 1500 and jobs < 20  # 30 blocks would be as many passes over the cells


def test_the_registered_index_s_recall(spark, sf_dir):
    exact = {(r["query_id"], r["vec_id"]) for r in catalog.vector_topk_batch(spark, sf_dir).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in persisted.vector_index_topk(spark, sf_dir).collect()}
    assert len(exact & found) / len(exact) >= 0.9
