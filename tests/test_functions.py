"""Literal fixtures of scalar functions, prompts and chat."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chunkwell.functions import text as T
from chunkwell.operators import chat, retrieval
from chunkwell.plans import prompt
from chunkwell.settings import Settings
from chunkwell.sources import files as sources


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("path", "expected"),
    [("a/b.PY", "py"), ("Dockerfile", "unknown"), (".gitignore", "unknown"), ("x/.eslintrc.json", "json"), ("foo.", ""), ("a.b/Makefile", "unknown"),
     ("..x.tar.gz", "gz"), ("...", "unknown"), ("a.tar.gz", "gz"), (".a.", ""), ("dir.d/x", "unknown")],
)
def test_file_type(spark, path, expected):
    assert one(spark, T.file_type(F.lit(path))) == expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [("https://host.example/Foo/bar.git", "Foo--bar"), ("https://host.example/a/foo.github.io", "a--foohub.io"), ("https://host.example/x/y/", "x--y--")],
)
def test_repository_name_keeps_quirks(spark, url, expected):
    assert one(spark, T.repository_name(F.lit(url))) == expected


def test_collection_name(spark):
    assert one(spark, T.collection_name(F.lit("__A..b/c é__"))) == "a..b_c"
    assert one(spark, T.collection_name(F.lit("x" * 62 + "_y"))) == "x" * 62 + "_"


def test_chunk_ids_of_two_paths_can_collide(spark):
    ids = {one(spark, T.chunk_id(F.lit("r"), F.lit(p), F.lit(1), F.lit(2))) for p in ("a/b.py", "a_b.py")}
    assert ids == {"r_a_b_py_1_2"}


def test_citations(spark):
    answer = "see [FILE: a/b.py, LINES: 1-5] and [FILE:c.py,LINES:7-9][FILE: a/b.py, LINES: 1-5] [FILE: x, y.py, LINES: 2-3]"
    assert [tuple(c) for c in one(spark, T.citations(F.lit(answer)))] == [("a/b.py", 1, 5), ("c.py", 7, 9), ("x, y.py", 2, 3)]


def test_digest(spark):
    bar = "=" * 48
    text = f"pre\n{bar}\nFILE: a/b.py\n{bar}\n\n    x = 1\ny\n\n{bar}\nFILE: c d.md\n{bar}\n# T\n\n{bar}\nFILE: empty.txt\n{bar}\n\n{bar}\nFILE: Z\n{bar}\nlast\n{'=' * 50}"
    rows = sources.split_digest(spark.createDataFrame([("r", text), ("s", "")], "repo_name string, digest string")).collect()
    assert {(r.file_path, r.content) for r in rows} == {("a/b.py", "x = 1\ny"), ("c d.md", "# T"), ("Z", "last\n" + "=" * 50)}


def test_digest_headers_as_they_come(spark):
    bar = "=" * 48
    heads = [f"{bar}\nFILE:b.py\n{bar}\nx", f"{bar}\nFILE: \n{bar}\nlost", f"{bar} FILE:  c.md  {bar} y", f"{bar}\n\nFILE:\td e.txt\n\n{bar}\n\nz"]
    rows = [("n", "\n".join(heads)), ("r", "\r\n".join(heads).replace("\n", "\r\n").replace("\r\r", "\r"))]
    got = sources.split_digest(spark.createDataFrame(rows, "repo_name string, digest string")).collect()
    assert sorted((r.repo_name, r.file_path, r.content) for r in got) == [(n, p, c) for n in "nr" for p, c in (("b.py", "x"), ("c.md", "y"), ("d e.txt", "z"))]


def test_undecodable_files_do_not_end_the_scan(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("é".encode("latin-1") + b" x")
    (tmp_path / "b.md").write_text("fine")
    rows = sources.read_directory(spark, str(tmp_path), "r").orderBy("file_path").collect()
    assert [r.content for r in rows] == ["\ufffd x", "fine"]


def test_strip_takes_the_blanks_of_unicode(spark):
    blanks = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    assert one(spark, T.strip(F.lit(blanks + "a \u3000b" + blanks))) == "a \u3000b" == (blanks + "a \u3000b" + blanks).strip()
    assert one(spark, T.is_blank(F.lit(blanks))) and not one(spark, T.is_blank(F.lit("\u200b")))


def test_urls_that_cannot_be_read(spark):
    assert [one(spark, T.repository_name(F.lit(u))) for u in ("http://[::1/a/b", "http://h/a[b", "http://[::1]/a/b")] == ["default-repo-name", "a[b", "a--b"]


def test_globs(spark):
    paths = ["a.py", "x/y.md", "node_modules/a.js", "q/node_modules/z/a.js", "b.min.js", "Makefile", "a.bin", "x/package.json"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").where(sources.wanted(F.col("p"))).collect()
    assert {r.p for r in rows} == {"a.py", "x/y.md", "Makefile", "x/package.json"}


def test_directory(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\r\ny = 2\r\n")
    (tmp_path / "big.md").write_text("x" * (512 * 1024 + 1))
    rows = sources.read_directory(spark, str(tmp_path), "r").collect()
    assert [(r.file_path, r.file_type, r.content) for r in rows] == [("src/a.py", "py", "x = 1\ny = 2\n")]


@pytest.mark.parametrize(("tokens", "left"), [([40, 49, 5, 1], 2), ([40, 50], 1)])
def test_budget_stops_at_first_misfit(spark, tokens, left):
    rows = spark.createDataFrame(list(enumerate(tokens)), "place int, tokens int")
    assert prompt.within_budget(rows, 10, 100).count() == left


def test_first_wins(spark):
    hits = [(0, 1, "A"), (0, 2, "B"), (1, 1, "B"), (1, 2, "C"), (2, 1, "A"), (2, 2, "D")]
    rows = retrieval.first_wins(spark.createDataFrame(hits, "query_no long, rank int, k string"), ["k"]).orderBy("place").collect()
    assert [r.k for r in rows] == ["A", "B", "C", "D"]


def test_chat(spark):
    turns = spark.createDataFrame([("a", 1, "q", "r")], "conversation_id string, turn int, query string, response string")
    new = spark.createDataFrame([("a", 1, "q2", "r2"), ("b", 1, "x", "y")], "conversation_id string, at int, query string, response string")
    rows = chat.add_messages(turns, new)
    assert sorted((r.conversation_id, r.turn, r["query"]) for r in rows.collect()) == [("a", 1, "q"), ("a", 2, "q2"), ("b", 1, "x")]
    assert chat.clear(rows, rows.where("conversation_id = 'a'")).count() == 1
    assert one(spark, prompt.history_text(F.array().cast("array<struct<query: string, response: string>>"))) == ""


def test_settings():
    assert Settings.load({"CHUNKWELL_TOP_K": "5"}).top_k == 5
    with pytest.raises(ValueError):
        Settings.load({}, key_required=True)
