"""Archives as file rows, against the same files read from a directory."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from chunkwell.functions import text as T
from chunkwell.sources.archives import _file_type, read_archives
from chunkwell.sources.files import read_directory

FILES = {
    "a.py": b"x = 1\r\n", "src/b.md": b"# T\n", "src/deep/c.txt": "é".encode("latin-1"), "node_modules/d.js": b"no", "e.png": b"no", "big.txt": b"x" * 600_000,
    "Makefile": b"all:\n", ".github/f.yml": b"on: push\n", "empty.json": b"",
}


@pytest.fixture
def root(tmp_path):
    for name, data in FILES.items():
        (tmp_path / "plain" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "plain" / name).write_bytes(data)
    (tmp_path / "packed" / "in").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "packed" / "One.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("One-main")
        for name, data in FILES.items():
            z.writestr(f"One-main/{name}", data)
    for ending, mode in (("tar", "w"), ("tar.gz", "w:gz"), ("txz", "w:xz")):
        with tarfile.open(tmp_path / "packed" / "in" / f"two.{ending}", mode) as t:
            for name, data in FILES.items():
                info = tarfile.TarInfo(f"./{name}")
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    (tmp_path / "packed" / "readme.txt").write_text("no archive")
    return tmp_path


def test_archives_equal_a_directory(spark, root):
    expected = sorted(tuple(r)[1:] for r in read_directory(spark, str(root / "plain"), "x").collect())
    expected = sorted([*expected, (".github/f.yml", "yml", "on: push\n"), ("empty.json", "json", "")])  # Spark lists no hidden folders and no empty files
    rows = read_archives(spark, str(root / "packed"))
    got = rows.collect()
    assert rows.rdd.getNumPartitions() == 4 and {r.repo_name for r in got} == {"One", "two"}
    assert sorted(tuple(r)[1:] for r in got if r.repo_name == "One") == expected and len(expected) == 6
    assert sorted(tuple(r)[1:] for r in got if r.repo_name == "two") == sorted(expected * 3)
    assert {r.file_path for r in read_archives(spark, f"file://{root}/packed/One.zip", max_bytes=4).collect()} == {"src/b.md", "src/deep/c.txt", "empty.json"}


def test_file_types_are_those_of_the_column_function(spark):
    names = ["a/b.PY", "Dockerfile", ".gitignore", "x/.eslintrc.json", "foo.", "..x.tar.gz", "...", ".a.", "dir.d/x", "a.tar.gz"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.file_type(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == {n: _file_type(n) for n in names}
