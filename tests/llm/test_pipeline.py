"""The pipeline on the smallest tables: planted rows go, clean rows stay, tokens are whole."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from chunkwell.llm.queries import tokenizer_path
from chunkwell.llm.wavelet import encoder

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The tables with an exact copy, a near copy, a benchmark passage and a text without words added."""
    root = tmp_path_factory.mktemp("planted")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    long = next(r for r in rows if r["text"] and 200 < len(r["text"].split()) < 400 and r["text"].isprintable() is False or r["text"] and 200 < len(r["text"].split()) < 400)
    near = long["text"].split()
    near[50] = "changed"
    passage = max((r.text for r in items if r.text), key=len)
    added = [(90_001, long["text"]), (90_002, " ".join(near)), (90_003, f"before it {passage} after it"), (90_004, " ")]
    rows += [long | {"doc_id": i, "text": t, "n_chars": len(t)} for i, t in added]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{root}/documents.parquet")
    for name in ("labels", "benchmark"):
        os.symlink(f"{DATA}/{name}.parquet", root / f"{name}.parquet")
    return str(root), {r["doc_id"]: r["text"] for r in rows}


def test_run(spark, planted):
    root, texts = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, root)
        assert left.columns == docs.columns, name
        kept.append(Counter(r.doc_id for r in left.collect()))
        docs = spark.createDataFrame(left.toPandas(), docs.schema)
    _, near, clean, mixed = kept
    assert 90_001 not in near and 90_002 not in near and 90_003 in near and 90_004 in near
    assert 90_003 not in clean and 90_004 in clean and set(mixed) == set(clean)
    out = corpus_pipeline.run(spark, root).orderBy("start").collect()
    assert Counter(r.doc_id for r in out) == mixed and len(set(mixed)) > 0.7 * len(texts)
    assert [r.doc_id for r in out] == sorted(mixed.elements())
    tok, start = encoder(tokenizer_path()).tokenizer, 0
    for r in out:
        tokens = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        start += len(tokens)
