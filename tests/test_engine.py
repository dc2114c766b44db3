"""The engine end to end, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import sys

import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chunkwell import catalogue
from chunkwell.operators import cells, chunking, retrieval
from chunkwell.operators.retrieval import HashedEmbedder, HashedVectors, ModelEmbedder
from chunkwell.plans.engine import EMPTY_ANSWER, FAILED_ANSWER, Engine, ExtractiveGenerator, NotFound, safe_answer, subquestions
from chunkwell.settings import Settings
from chunkwell.sources.store import Manifest, Store, embedded, with_ids

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not import the tests
DATA = "/root/testdata/sf0.001"
RAW = "repo_name string, file_path string, file_type string, content string"


class Asking:
    def __init__(self, reply=None):
        self.reply = reply

    def generate(self, prompt):
        if self.reply is None:
            raise RuntimeError
        return self.reply

    structured = generate


def test_engine(spark, tmp_path):
    engine = Engine(spark, Settings(store_path=str(tmp_path / "store")))
    files = spark.createDataFrame([("Foo", "a.txt", "txt", "the parser reads tokens"), ("Foo", "b.py", "py", "def parse():\n    pass\n")], RAW)
    engine.ingest(files, "Foo")
    assert engine.repos() == ["foo"]
    session = engine.new_session()
    answer = engine.query("Foo", "parser tokens", session)
    assert answer["sources"][0]["file_path"] == "a.txt" and answer["status"] == "ok"
    assert engine.chats[session] == [("parser tokens", answer["answer"])]
    newer = spark.createDataFrame([("Foo", "a.txt", "txt", "the parser was rewritten")], RAW)
    engine.ingest(newer, "Foo")
    assert {r.document if "document" in r else r.content for r in engine.store.read("foo").collect()} == {"the parser was rewritten", "def parse():\n    pass"}
    engine.ingest(newer, "Foo", mode="replace")
    assert engine.store.read("foo").count() == 1
    engine.ingest(newer.where("false"), "Foo", mode="replace")
    assert engine.store.read("foo").count() == 1
    with pytest.raises(NotFound):
        engine.query("Foo", "zzz qqq")
    with pytest.raises(NotFound):
        engine.query("other", "x")
    with pytest.raises(ValueError):
        engine.query("Foo", "x", top_k=2)
    engine.delete("FOO")
    assert engine.repos() == []
    engine.clear("unknown")
    assert engine.sessions() == [session]


def test_answers_that_find_nothing_are_not_kept(spark, tmp_path):
    engine = Engine(spark, Settings(store_path=str(tmp_path / "store"), two_pass=False), generator=Asking("Sorry. I could not find any relevant information here."))
    lost = engine.ingest(spark.createDataFrame([("r", "a.txt", "txt", "the parser"), ("r", "b.txt", "txt", " \n"), ("r", "c.txt", "txt", None)], RAW), "r")
    assert sorted((x["file_path"], x["error"]) for x in lost) == [("b.txt", "blank"), ("c.txt", "no content")]
    session = engine.new_session()
    with pytest.raises(NotFound):
        engine.query("r", "parser", session)
    assert engine.chats == {session: []}
    engine.generator = Asking("fine")
    for n in range(3):
        engine.query("r", f"parser {n}", session)
    engine.query("r", "parser", "given")
    assert [q for q, _ in engine.chats[session]] == ["parser 0", "parser 1", "parser 2"] and engine.sessions() == [session, "given"]
    engine.clear(session)
    assert engine.chats == {"given": [("parser", "fine")]}


def chunks_of(spark, *paths, text="words of {}"):
    rows = [("r", p, "txt", text.format(p)) for p in paths]
    return embedded(with_ids(chunking.chunk_files(spark.createDataFrame(rows, RAW))), HashedEmbedder())


def test_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    a, b = Store(spark, root, keep_seconds=0), Store(spark, root, max_records=1, keep_seconds=0)
    a.write("R", chunks_of(spark, "a.txt"))
    publish, raced = a._publish, []

    def late(normal, number, manifest):
        if not raced:
            raced.append(b.write("r", chunks_of(spark, "b.txt")))  # another writer comes first
        return publish(normal, number, manifest)

    a._publish = late
    a.write("r", chunks_of(spark, "c.txt"))
    assert {r.file_path for r in b.read("r").collect()} == {"a.txt", "b.txt", "c.txt"}
    assert len(b._manifests("r")) == 2 and not list((tmp_path / "store" / "r").rglob("new-*")) and not list((tmp_path / "store" / "r" / "manifests").glob(".??*[0-9a-f]"))
    b.write("r", a.read("r"))
    assert len(list((tmp_path / "store" / "r" / "data").glob("*/*/part-*.parquet"))) >= 3
    a.write("empty", chunks_of(spark, "a.txt").where("false"))
    assert a.list() == ["r"] and not a.delete("empty") and a.delete("R") and a.list() == []


def test_writers_that_died_leave_no_trace(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write("r", chunks_of(spark, "a.txt"))
    manifests = tmp_path / "store" / "r" / "manifests"
    (manifests / "000000000002").write_bytes(b"")  # made, but never written
    (manifests / ".half").write_text('{"buckets"')
    (tmp_path / "store" / "r" / "data" / "v-dead").mkdir()
    assert [r.file_path for r in store.read("r").collect()] == ["a.txt"]
    store.write("r", chunks_of(spark, "b.txt"))
    assert sorted(r.file_path for r in store.read("r").collect()) == ["a.txt", "b.txt"]
    (manifests / "000000000004").write_bytes(b"")
    store.write_all(chunks_of(spark, "c.txt"), F.col("repo_name"))
    assert [r.file_path for r in store.read("r").collect()] == ["c.txt"]


def test_only_buckets_with_new_ids_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=8, keep_seconds=0)
    store.write("r", chunks_of(spark, *(f"{k}.txt" for k in range(60))))
    before = store._last("r")[1].folders
    files = lambda: {p.name: p.stat().st_mtime_ns for f in before.values() for p in (tmp_path / "store" / "r" / f).glob("*.parquet")}
    there = files()
    store.write("r", chunks_of(spark, "7.txt", "new.txt", text="changed {}"))
    after = store._last("r")[1].folders
    changed = {b for b in before if before[b] != after[b]}
    assert 1 <= len(changed) <= 2 and files() == there and len(before) == 8
    rows = {r.file_path: r.content for r in store.read("r").collect()}
    assert len(rows) == 61 and rows["7.txt"] == "changed 7.txt" and rows["8.txt"] == "words of 8.txt" and rows["new.txt"] == "changed new.txt"
    for k in range(3):  # folders that only older manifests name go
        store.write("r", chunks_of(spark, "7.txt", text=f"again {k} {{}}"))
    assert not any((tmp_path / "store" / "r" / before[b]).exists() for b in changed if before[b] != store._last("r")[1].folders[b])
    ids = [r.id for r in store.read("r").where("file_path in ('3.txt', '7.txt')").collect()]
    assert sorted(r.file_path for r in store.fetch("r", [*ids, "none"]).collect()) == ["3.txt", "7.txt"]
    assert len(store.fetch("r", ids[:1]).inputFiles()) == 1 and store.fetch("other", ids).count() == 0


def test_names_are_published_once_on_any_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store._publish("r", 1, Manifest(4)) and not store._publish("r", 1, Manifest(5)) and store._last("r") == (1, Manifest(4))
    store._links = False  # as on stores other than local folders
    assert store._publish("r", 2, Manifest(6)) and not store._publish("r", 2, Manifest(7)) and store._last("r") == (2, Manifest(6))


def test_reads_that_were_planned_may_end(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write("r", chunks_of(spark, "a.txt"))
    planned = store.read("r")
    for k in range(4):
        store.write("r", chunks_of(spark, "a.txt", text=f"v{k}"))
    assert [r.content for r in planned.collect()] == ["words of a.txt"]


class Planes:
    """A model of 384 dimensions: the words of a text set places of a vector."""

    dimensions = 384

    def encode(self, texts):
        return HashedVectors(384).encode(texts) / 2


def test_dense_vectors_are_stored_and_retrieved(spark, tmp_path):
    engine = Engine(spark, Settings(store_path=str(tmp_path / "store"), two_pass=False), embedder=ModelEmbedder(Planes))
    topics = ["the parser reads tokens", "the cook boils pasta", "rain falls on hills", "ships cross the sea"]
    rows = [("d", f"{k}.txt", "txt", f"{topics[k % 4]} {k}") for k in range(80)]
    engine.ingest(spark.createDataFrame(rows, RAW), "d")
    stored = engine.store.read("d").collect()
    assert len(stored) == 80 and {len(r.vector) for r in stored} == {384} and all(r.cell is None and r.embedding == [] for r in stored)
    answer = engine.query("d", "pasta the cook boils 1")
    assert answer["sources"][0]["file_path"] == "1.txt"
    assert engine.store.index("d", cells=6)
    cells = {r.cell for r in engine.store.read("d").collect()}
    assert None not in cells and 2 <= len(cells) <= 6
    assert engine.query("d", "pasta the cook boils 1")["sources"] == answer["sources"]
    engine.ingest(spark.createDataFrame([("d", "new.txt", "txt", "the cook boils pasta 1 again")], RAW), "d")  # later records get a cell too
    assert engine.store.fetch("d", ["d_new_txt_1_1"]).collect()[0].cell in cells
    plan = engine.store.nearest("d", {0: stored[0].vector}, 3, probes=1)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and ("In(cell" in plan or "EqualTo(cell" in plan)


@pytest.mark.parametrize("spread", [0.3, 1.0])
def test_recall_of_cells(spark, tmp_path, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32))
    points = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * spread
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points.astype(np.float32))] + [(9000, None)], "vec_id long, vector array<float>")
    model = cells.train(rows, "vec_id")
    put = cells.with_cell(rows, model).cache()
    assert put.where("cell is null").count() == 1 and put.columns == ["vec_id", "vector", "cell"]
    queries = spark.createDataFrame([(k, (points[k] + 0.1).tolist()) for k in range(0, 4000, 50)], "query_no long, point array<double>")
    exact = {(r.query_no, r.rank): (r.vec_id, r.distance) for r in retrieval.nearest_to_each(rows, queries, 10, embedding="vector").collect()}
    every = {(r.query_no, r.rank): (r.vec_id, r.distance) for r in cells.search(put, model, queries, 10, probes=None, most_queries=33).collect()}
    assert every == exact and len(exact) == 800
    few = cells.search(put, model, queries, 10).collect()
    truth = {(q, v) for (q, _), (v, _) in exact.items()}
    recall = len(truth & {(r.query_no, r.vec_id) for r in few}) / len(truth)
    assert recall >= 0.9
    assert cells.train(rows.where("false"), "vec_id") is None


def test_recall_of_cells_on_the_vectors_of_the_tables(spark):
    from chunkwell.catalogue import QUERIES

    few, every = ({(r.query_no, r.vec_id) for r in QUERIES[n](spark, DATA).collect()} for n in ("cells_search", "cells_exact"))
    assert len(few & every) >= 0.9 * len(every) and len(every) >= 30


def test_files_that_do_not_parse_are_reported(spark, tmp_path):
    engine = Engine(spark, Settings(store_path=str(tmp_path / "store")))
    rows = [("e", "bad.py", "py", "def broken(:\n    pass\n"), ("e", "good.py", "py", "x = 1\n"), ("e", "nul.py", "py", "x = '\0'\n"), ("e", "blank.txt", "txt", " ")]
    lost = engine.ingest(spark.createDataFrame(rows, RAW), "e")
    assert [x["file_path"] for x in lost] == ["blank.txt"]
    assert {(r.file_path, r.chunk_type) for r in engine.store.read("e").collect()} == {("bad.py", "text_block"), ("good.py", "top_level_code"), ("nul.py", "text_block")}
    assert {(r.file_path, r.error.split(":")[0]) for r in engine.store.errors("e").collect()} == {("bad.py", "SyntaxError"), ("nul.py", "SyntaxError")}
    engine.delete("e")
    assert engine.store.errors("e").count() == 0


class Splitting(ExtractiveGenerator):
    def structured(self, prompt):
        return '{"subquestions": ["rain", "ships"]}' if "pasta" in prompt.split("Original User Query: ")[1].split("\n")[0] else "no"


def test_many_questions_are_answered_as_one_by_one(spark, tmp_path):
    texts = ["the parser reads tokens", "the cook boils pasta", "rain falls on hills", "ships cross the sea"]
    rows = spark.createDataFrame([("m", f"{k}.txt", "txt", f"{t} {'x ' * 3000 if k == 3 else ''}") for k, t in enumerate(texts)], RAW)
    asked = ["boils pasta", "zzz", "ships sea"]
    for two_pass in (True,):
        engine = Engine(spark, Settings(store_path=str(tmp_path / f"store{two_pass}"), two_pass=two_pass), generator=Splitting())
        engine.ingest(rows, "m")
        got = engine.query_many("m", spark.createDataFrame(list(enumerate(asked)), "q long, query string"), "q", load=Splitting)
        found = {r.q: (r.answer, [s.asDict() for s in r.sources], r.status) for r in got.collect()}
        assert len(found) == len(asked)
        for q, text in enumerate(asked):
            try:
                one = engine.query("m", text)
                assert found[q] == (one["answer"], one["sources"], "ok")
            except NotFound:
                assert found[q][2] == "not_found" and found[q][1] == []


def test_sparse_top_k_computes_each_product_once(spark):
    rows = spark.createDataFrame([(k, f"word{k % 3} and more") for k in range(9)], "i long, text string")
    made = retrieval.HashedEmbedder().add(rows.repartition(2), "text")
    plan = retrieval.sparse_top_k(made, "i", made.withColumnRenamed("i", "q"), "q", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(".weight * coalesce(") == 1


def test_sparse_top_k_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = lambda n: [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 9)))) for i in range(n)]
    items, asked, model = texts(120), texts(150), HashedEmbedder()
    tables = [model.add(spark.createDataFrame(x, f"{n} long, t string"), "t") for x, n in ((items, "i"), (asked, "q"))]
    vectors = [{r[0]: {e.bucket: e.weight for e in r.embedding} for r in t.collect() if r.embedding} for t in tables]
    expected = set()
    for q, v in vectors[1].items():
        score = lambda w, v=v: sum(x * w.get(b, 0) for b, x in v.items()) / (sum(x * x for x in v.values()) ** 0.5 * sum(x * x for x in w.values()) ** 0.5)
        best = sorted((-round(score(w), 12), i) for i, w in vectors[0].items() if score(w) > 0)[:4]
        expected |= {(q, s) for s, _ in best}
    got = retrieval.sparse_top_k(tables[0], "i", tables[1], "q", 4, most_queries=40).collect()
    assert {(r.q, -round(r.score, 12)) for r in got} == expected


def test_generators():
    assert safe_answer(Asking(), "p") == FAILED_ANSWER
    assert safe_answer(Asking(" "), "p") == EMPTY_ANSWER
    assert subquestions(Asking('{"subquestions": ["a", "b"]}'), "p") == ["a", "b"]
    assert subquestions(Asking("no"), "p") == [] and subquestions(Asking(), "p") == []


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in ("customer", "documents", "embeddings", "pages", "benchmark", "conversations"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def values(frame):
    names = sorted(frame.columns)
    return sorted(repr([None if x is None or x != x else x for x in row]) for row in frame[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, tables, name):
    got, expected = catalogue.QUERIES[name](spark, DATA).toPandas(), tables.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    plain = lambda rows: [r.replace(".0", "") for r in rows]
    assert plain(values(got)) == plain(values(expected))


def _nearest_plainly(rows, points, k):
    """Query, rank, key and distance by loops; missing numbers count nothing, and without a common one there is no distance."""
    out = []
    for q, p in points:
        found = []
        for key, v in rows:
            terms = [(float(a) - float(b)) * (float(a) - float(b)) for a, b in zip(v, p) if a is not None and b is not None]  # noqa: B905
            found.append((not terms, float(np.cumsum(terms)[-1]) if terms else 0.0, key))
        found.sort(key=lambda f: (f[0], f[1] != f[1], f[1], f[2]))
        out += [(q, n + 1, key, None if none else repr(d)) for n, (none, d, key) in enumerate(found[:k])]
    return sorted(out)


def test_nearest_to_each_equals_loops_on_odd_vectors_and_copies(spark):
    rng = np.random.default_rng(5)
    inf, nan = float("inf"), float("nan")
    odd = [[], [None] * 6, [1.0, None, 2.0], [inf] * 6, [nan, 1.0], [1e300] * 6, [1e-200] * 6, [0.0] * 8]
    rows = [(k, v) for k, v in enumerate([*odd, *([[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 300), *np.round(rng.normal(size=(200, 6)), 1).tolist()])]
    points = [(0, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (1, [inf] * 6), (2, [None, 1.0]), (3, [nan] * 6), (4, []), (5, [1e-200] * 6), *((k, rng.normal(size=6).tolist()) for k in range(6, 90))]
    vectors = spark.createDataFrame([(k, v, f"l{k}") for k, v in rows] + [(999, None, "none")], "vec_id long, embedding array<double>, label string").repartition(3)
    queries = spark.createDataFrame(points, "query_no long, point array<double>")
    with np.errstate(all="ignore"):
        expected = _nearest_plainly(rows, points, 5)
    got = retrieval.nearest_to_each(vectors, queries, 5, most_queries=40).collect()
    assert sorted((r.query_no, r["rank"], r.vec_id, None if r.distance is None else repr(r.distance)) for r in got) == expected
    assert all(r.label == f"l{r.vec_id}" for r in got)


def test_many_queries_are_compared_by_products(spark):
    """Pairs one by one took a minute and more for so many on four cores."""
    import time

    rng = np.random.default_rng(6)
    points = rng.normal(size=(8000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<float>").cache()
    rows.count()
    started = time.time()
    found = retrieval.nearest_to_each(rows, rows.where("vec_id < 4000").select(F.col("vec_id").alias("query_no"), F.col("embedding").alias("point")), 3).where("rank = 1").collect()
    assert len(found) == 4000 and all(r.vec_id == r.query_no and r.distance == 0.0 for r in found)
    assert time.time() - started < 30
