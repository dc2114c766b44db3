"""Training-data operators against brute force, exact round trips and awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwell.llm import decontam, langid, linededup, minhash, mixing, secrets, topk, toxicity, warc, wavelet
from chunkwell.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0, 0.5, 1) for i, t, g in rows], DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with outputs."""
    long = prose(random.Random(1), 60_000, 5000)
    return docs(spark, [(1, None, "en"), (2, "", None), (None, "some words without an id at all", "en"), (3, " \t\n", "en"), (4, long, "en"), (5, "x", "en"), (5, "x", "en"), (6, "Ünïcode ẞ word", "de")])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = prose(rng, 80).split()
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"z{rng.randrange(999)}"
            rows.append((len(rows), " ".join(own), "en"))
    rows += [(900, "a b", "en"), (901, "A  b", "en"), (902, "a b c", "en"), (903, None, "en"), (904, "", "en")]
    sets, label = {i: shingles(t) for i, t, _ in rows}, {i: i for i, *_ in rows}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates_awkward(spark):
    got = minhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == 8 and all(r.component_id == r.doc_id for r in got) and all(r.kept for r in got)
    assert minhash.near_duplicates(awkward(spark).where("false")).count() == 0
    assert minhash.one_of_each_group(awkward(spark)).count() == 7


def test_parity_bound_never_rejects_a_link():
    rng, sets, alike = np.random.default_rng(3), [], []
    for size in (1, 4, 7, 60, 700, 9000):
        for share in (0.5, 0.7, 0.74, 0.75, 0.76, 0.9, 1.0):
            both = int(np.ceil(size * share))
            pool = rng.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64)
            sets += [np.sort(pool[:size]), np.sort(pool[size - both :])]
            alike.append(100 * both >= 75 * (2 * size - both))
    signs = minhash._matrix(pa.array([s.tobytes() for s in minhash.signatures(sets)], pa.binary()))
    left, right = np.arange(0, len(sets), 2), np.arange(1, len(sets), 2)
    found = minhash._may_reach(signs[left], signs[right])
    assert found[np.array(alike)].all()
    assert not found[~np.array(alike) & (signs.size[left] < 100)].any()


def test_passages(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, n)) for k, n in enumerate([5, 12, 20, 30, 30, 50])] + [(20, "only three words"), (21, None), (22, "")]
    rows = []
    for i in range(40):
        body = prose(rng, 60).split()
        if i % 2:
            passage = items[rng.randrange(7 if i % 3 else 6)][1].split()
            if len(passage) > 20 and i % 4 == 1:
                passage[len(passage) // 2] = "changed"
            body[30:30] = passage
        rows.append((i, " ".join(body), "en"))
    expected = {}
    for i, text, _ in rows:
        for k, item in items:
            a, b = words(text), words(item)
            n = min(5, len(b))
            if not b or len(a) < len(b):
                continue
            bag = lambda x, n=n: Counter(tuple(x[j : j + n]) for j in range(len(x) - n + 1))
            best = 0.0
            for s in range(len(a) - len(b) + 1):
                own = bag(a[s : s + len(b)])
                both = sum((own & bag(b)).values())
                best = max(best, both / (own.total() + bag(b).total() - both))
            if best >= 0.75:
                expected[i, k] = best
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_passages(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(expected)
    clean = decontam.drop_contaminated(docs(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, *_ in rows} - {i for i, _ in expected}
    assert decontam.find_passages(awkward(spark), bench).count() == 0
    assert decontam.find_passages(docs(spark, rows), bench.where("false")).count() == 0


def test_decontamination_starts_no_workers_but_its_own(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("one two three four five six seven").alias("text"))
    found = decontam.find_passages(rows, bench)
    plan = found._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan  # a table of Python's has a pool of workers for itself
    assert found.count() == 3 and found.columns == ["doc_id", "item_id", "similarity", "first_word"]


def test_hashes_do_not_depend_on_blocks():
    from chunkwell.llm import _shared

    rng = random.Random(31)
    texts = [prose(rng, 60_000), "", "x" * (3 * _shared.BLOCK + 5), prose(rng, 5)]
    got = _shared.split_words(pa.array(texts, pa.string()))
    alone = {w: int(_shared.split_words(pa.array([w], pa.string())).hash[0]) for w in set(" ".join(texts).split()) if len(w) < 100}
    assert [alone[w] for w in texts[0].split()] == got.hash[: got.ptr[1]].tolist() and [alone[w] for w in texts[3].split()] == got.hash[got.ptr[3] :].tolist()
    assert len(texts[0]) > 2 * _shared.BLOCK and got.ptr[3] - got.ptr[2] == 1
    assert _shared._POWERS.nbytes + _shared._INVERSES.nbytes <= 4 << 20  # every worker holds them


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(2)
    family = decontam.Family(9, [(k, rng.integers(1, 2**63, 5).astype(np.uint64)) for k in range(30)])
    prints = rng.integers(0, 256, (200, 8)).astype(np.uint8)
    exact = {(i, j) for i in range(200) for j in range(30) if np.bitwise_count(prints[i] ^ family.prints[j]).sum() <= decontam.RADIUS}
    assert set(zip(*(x.tolist() for x in family.candidates(prints)), strict=True)) == exact and exact


def test_line_runs(spark):
    rng = random.Random(7)
    block = [prose(rng, 20) for _ in range(4)]
    rows = [(1, "\n".join(["start", *block, "end"]), "en"), (2, "\n".join(["other", "", *block[1:], "tail"]), "en"), (3, "\n".join([block[0], "short"]), "en"), (4, "\n".join(block + block), "en")]
    got = {r.doc_id: r for r in linededup.deduplicated(docs(spark, rows)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [0, 3, 0, 8]
    assert got[2].text == "other\n\ntail" and got[2].removed == "2-4" and got[1].text == rows[0][1]
    odd = linededup.deduplicated(awkward(spark)).collect()
    assert len(odd) == 8 and {r.n_removed for r in odd} == {0}
    assert linededup.deduplicated(awkward(spark).where("false")).count() == 0


def removed_by_brute_force(rows, least=50):
    """Line numbers by document and text of every run of `least` words or more that occurred before, blank lines within it too."""
    order = lambda x: (x[0], (xxhash.xxh64_intdigest(x[1].encode(), 42) + (1 << 63)) % (1 << 64))
    seen, gone = {}, {(i, text): set() for i, text, _ in rows}
    for i, text, _ in sorted(set(rows), key=order):
        lines = [(n, tuple(x.split())) for n, x in enumerate(text.split("\n")) if x.split()]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(map(len, run)) >= least and seen.setdefault(run, (i, text, a)) != (i, text, a):
                    gone[i, text] |= set(range(lines[a][0], lines[b][0] + 1))
    return gone


def test_line_runs_of_uneven_lines_go_whole(spark):
    rng = random.Random(17)
    three = [prose(rng, n) for n in (30, 30, 10)]
    tail = [prose(rng, 60), *(prose(rng, 4) for _ in range(10))]
    paragraphs = "\n\n".join(prose(rng, 70) for _ in range(3))
    rows = [(k + 2 * i, "\n".join([f"start{i} {k}", *block, f"end{i} {k}"]), "en") for i, block in enumerate((three, tail, [paragraphs])) for k in (0, 1)]
    pool = [[prose(rng, rng.choice([1, 3, 8, 20, 33, 49, 50, 51, 70])) for _ in range(9)] for _ in range(6)]
    for i in range(10, 50):
        text = []
        for _ in range(3):
            lines, a = rng.choice(pool), rng.randrange(6)
            text += [*lines[a : a + rng.randrange(1, 9)], *rng.choice([[], [""], [prose(rng, 5)]])]
        rows.append((i, "\n".join(text), "en"))
    expected = removed_by_brute_force(rows)
    assert [len(expected[rows[i][:2]]) for i in (1, 3, 5)] == [3, 11, 5]
    check_removed(spark, rows)


def check_removed(spark, rows):
    """Every row's removed lines and remaining text are those of brute force."""
    expected = removed_by_brute_force(rows)
    lines_of = lambda runs: {n for x in filter(None, runs.split(",")) for n in range(int(x.split("-")[0]), int(x.split("-")[1]) + 1)}
    left = lambda text, gone: "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
    got = Counter((r.doc_id, r.text, frozenset(lines_of(r.removed))) for r in linededup.deduplicated(docs(spark, rows)).collect())
    assert got == Counter((i, left(t, expected[i, t]), frozenset(expected[i, t])) for i, t, _ in rows)
    return expected


def test_line_runs_of_one_id_ties_and_repeated_rows(spark):
    rng = random.Random(19)
    block = [prose(rng, 30) for _ in range(3)]
    rows = [(1, "\n".join(["a", *block, "b"]), "en"), (1, "\n".join(["c", *block, "d"]), "en")]  # the same run at the same line of one id
    rows += [(2, "\n".join([*block, *block]), "en")] * 3 + [(3, "\n".join(block[::-1]), "en"), (3, "x", "en"), (4, "\n".join(["the end"] * 60), "en")]
    expected = check_removed(spark, rows)
    assert sorted(len(expected[r[:2]]) for r in rows[:2]) == [0, 3] and len(expected[rows[2][:2]]) == 6


def test_line_runs_of_random_texts_equal_brute_force(spark):
    rng, rows = random.Random(20), []
    lines = [prose(rng, n, 30) for n in (1, 2, 5, 11, 17, 24, 26, 49, 50, 51, 80)]
    for i in range(60):
        rows.append((i // 2, "\n".join(rng.choice([*lines, "", "\t"]) for _ in range(rng.randrange(1, 14))), "en"))
    check_removed(spark, rows)


def test_bundles(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 50 + 1)) for i in range(300)] + [(301, None, None), (302, "u", ""), (None, "n", "alone"), (302, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    last: dict[str, int] = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    expected = Counter()
    for i, _, h in rows:
        raw, top = (h or "").encode(), last.get(h or "")
        refers = top if top is not None and i != top else None
        expected[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers] += 1
    got = warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == expected
    assert warc.archive(pages.where("false")).count() == 0


def test_bundles_of_bounded_frames(spark, monkeypatch):
    from pyspark.sql.functions import input_file_name

    rows = [(i, f"u{i}", "".join(random.Random(i).choices("abcdefgh", k=120_000))) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.shared_dir(spark, "bounded")
    monkeypatch.setattr(warc, "BUNDLE_FRAMES", 4)
    warc.write(pages.repartition(1), path)
    got = warc.read(spark, path).collect()
    assert sorted(r.page_id for r in got) == list(range(40)) and all(r.frame < 4 for r in got)
    assert len({r.file for r in got}) >= 3 and spark.read.format("binaryFile").load(path).select(input_file_name()).count() == len({r.file for r in got})


def test_bundle_is_plain_zstandard():
    bundle, raws = warc.Bundle(), [warc.record(i, "u", b"x" * (i * 997 % 90_000), None) for i in range(40)]
    ids = [None if i == 3 else 1000 - i // 2 for i in range(40)]
    rows = [r for i, x in zip(ids, raws, strict=True) if (r := bundle.add(i, x))]
    content = b"".join(r + bytes([warc.END]) for r in [*rows, *bundle.finish()])
    reader = warc.Reader(content)
    assert [reader.raw(k) for k in (39, 0, 17)] == [raws[39], raws[0], raws[17]] and len(reader) == 40
    assert [reader.find(i) for i in (None, 1000, 999, 981, 5)] == [[3], [0, 1], [2], [38, 39], []]
    taken = []
    ranged = warc.Reader(lambda at, n: taken.append(n) or content[at : at + n], len(content))
    taken.clear()
    assert [h["WARC-Record-ID"] for h, _ in ranged.get(981)] == ["<urn:page:38>", "<urn:page:39>"] and 0 < sum(taken) < len(content) / 2
    assert zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read() == b"".join(raws)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)] + [(700 + i, [0.5] * 8) for i in range(60)]
    odd = [(5000, None), (5001, [float("nan")] * 8), (5002, [1.0, None] * 4), (5020, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + odd], "vec_id long, embedding array<float>, score int, rank int")
    whole = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in vectors}
    expected = set()
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:20]
            expected |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    got = topk.top_k(table, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert set(map(tuple, got)) == expected and len(got) == len(expected)
    assert topk.top_k(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_tree_boxes_hold_their_rows_and_leaves_every_row_once():
    rng = np.random.default_rng(6)
    rows = rng.integers(-9, 9, (3000, 4)).astype(np.float64)
    tree = topk.Tree(np.arange(3000), rows)
    assert sorted(np.concatenate([i for i, _ in tree.leaves.values()]).tolist()) == list(range(3000))
    q = rng.normal(size=(5, 4))
    bounds = tree.bounds(q)
    assert all(((r @ q.T).max(axis=0) <= bounds[:, k] + 1e-9).all() for k, (_, r) in tree.leaves.items())
    for node, children in enumerate(tree.children):
        if children is not None:
            assert (bounds[:, children] <= bounds[:, [node]] + 1e-9).all()


def test_search_visits_few_leaves_of_clustered_rows():
    rng = np.random.default_rng(7)
    rows = np.concatenate([rng.normal(size=(600, 6)) + 40 * rng.normal(size=6) for _ in range(20)]).round()
    tree, asked = topk.Tree(np.arange(len(rows)), rows), rows[::1000]
    seen = []
    tree.leaves = type("Leaves", (dict,), {"__getitem__": lambda self, k: seen.append(k) or dict.__getitem__(self, k)})(tree.leaves)
    found = {q: (ids.tolist(), scores.tolist()) for q, ids, scores in topk.search(tree, np.arange(0, len(rows), 1000), asked, np.full(len(asked), -np.inf), 5)}
    for q, query in enumerate(asked):
        best = sorted((-(r @ query), i) for i, r in enumerate(rows) if i != 1000 * q)[:5]
        assert found[q] == ([i for _, i in best], [-s for s, _ in best])
    assert len(seen) < len(asked) * len(tree.leaves) / 2


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [2.0**56, 1.0]), (3, [1.0, 1e308]), (4, [3.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top, floor = 2**63 - 1, -(2**63)
    whole = {i: [min(max(math.floor(x * 64), floor), top) if abs(x) < 1e300 else top for x in v] for i, v in rows}
    expected = sorted((-min(max(sum(a * b for a, b in zip(whole[0], v, strict=True)), -top), top), i) for i, v in whole.items() if i)
    got = topk.top_k(table, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert sorted((-r.score, r.vec_id) for r in got) == expected and len(got) == 4


def _labelled(spark, n=900):
    rng = random.Random(9)
    bad, rows, marks = ["vile", "scumbag", "rotten"], [], []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        text = [f"{lang}{rng.randrange(300)}x" + ("ing" if lang == "en" else "ung") for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(text), lang))
        marks.append((i, 1, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(marks + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), marks


def test_toxicity(spark):
    table, labels, marks = _labelled(spark)
    got = toxicity.toxicity(table, labels).collect()
    truth = {i: t for i, _, t in marks}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.85 and all(0 <= r.score <= 1 for r in got)
    left = toxicity.drop_toxic(table, labels)
    assert left.columns == table.columns and 0.6 * len(got) < left.count() < 0.9 * len(got)
    assert toxicity.drop_toxic(table.drop("lang"), labels).columns == table.drop("lang").columns
    odd = toxicity.toxicity(awkward(spark), labels).collect()
    assert len(odd) == 8 and all(r.score is not None for r in odd)
    assert toxicity.toxicity(table.where("false"), labels.where("false")).count() == 0
    assert {r.score for r in toxicity.toxicity(awkward(spark), labels.where("false")).collect()} == {0.0}


def test_languages(spark):
    table, *_ = _labelled(spark, 300)
    got = langid.languages(table).collect()
    truth = {r.doc_id: r.lang for r in table.collect()}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.97
    field = langid.train(table)
    odd = {(r.doc_id, r.lang_pred) for r in langid.identify(awkward(spark), field).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= odd
    assert {r.lang_pred for r in langid.languages(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.languages(table.where("false")).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(8)
    e, moves = rng.random((5, 3)) + 0.1, rng.normal(size=(3, 3))
    total, expected = np.zeros((5, 3)), np.zeros((3, 3))
    for path in np.ndindex(*[3] * 5):
        w = np.prod([e[t, y] for t, y in enumerate(path)]) * np.exp(sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, y in enumerate(path):
            total[t, y] += w
        for a, b in zip(path, path[1:], strict=False):
            expected[a, b] += w
    mass = total[0].sum()
    for block in (1, 2, 3, 5, 256):
        mean, pairs = langid.forward_backward(e, np.array([0, 5]), moves, pairs=True, block=block)
        assert np.allclose(mean, total / mass) and np.allclose(pairs, expected / mass)


def test_blocks_change_nothing():
    rng = np.random.default_rng(18)
    ptr = np.concatenate(([0], np.cumsum(rng.integers(0, 40, 30))))
    e, moves = np.exp(3 * rng.normal(size=(ptr[-1], 4))), rng.normal(size=(4, 4))
    whole = langid.forward_backward(e, ptr, moves, pairs=True, block=1000)
    for block in (1, 7, 16):
        assert all(np.allclose(a, b) for a, b in zip(whole, langid.forward_backward(e, ptr, moves, pairs=True, block=block), strict=True))


def test_word_features_cover_every_byte():
    features = langid.Features({"der": 1})
    ids, owner = features(["der", "...", "Über-Maß9", "a" * 50 + "b" + "c" * 50])
    assert np.bincount(owner, minlength=4).tolist() == [1 + 1 + 6 + 2 + 1, 0, 1 + 6 + 8 + 7, 1 + 6 + 100 + 99]
    assert (features(["..."])[0].size, features([])[0].size) == (0, 0) and ids.max() < langid.BUCKETS


def test_encoder_equals_the_library():
    enc = wavelet.encoder(tokenizer_path())
    texts = ["a  b\n\n c d", "Hello, world.\nIt is 5 o'clock. don't", "", " lead", "trail ", "\n", "x\n", "été à \xa0b", "<|endoftext|> foo<|endoftext|>", "a\tb c\x00d", "zz ​ q,. w..", None, "\n\n\nX Y\r\nZ"]
    ids, lengths = enc.encode(pa.array(texts))
    expected = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(expected, []) and lengths.tolist() == list(map(len, expected))


_ALPHABET = list("abzABZ059 \n\t\r.,'!%-_<|>é×÷ßĀɏɐ²µ€’\u00a0\u3000中😀\u0301\u200b") + [" the", " don't", "'s", "  ", "<|endoftext|>", " Überß"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_ALPHABET), max_size=25).map("".join), min_size=1, max_size=6))
def test_encoder_equals_the_library_on_any_text(texts):
    enc = wavelet.encoder(tokenizer_path())
    ids, lengths = enc.encode(pa.array(texts))
    expected = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(expected, []) and lengths.tolist() == list(map(len, expected))


def test_encoder_forgets_pieces_and_stays_right(monkeypatch):
    monkeypatch.setattr(wavelet, "CACHED_PIECES", 50)
    enc, rng = wavelet.Encoder(tokenizer_path()), random.Random(31)
    for _ in range(8):
        texts = [" ".join("".join(rng.choice("abcéß") for _ in range(rng.randrange(1, 7))) for _ in range(40)) for _ in range(3)]
        ids, _ = enc.encode(pa.array(texts))
        assert ids.tolist() == sum((enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts), [])


def test_token_file_reads_only_what_it_needs():
    rng, levels = np.random.default_rng(4), 16
    parts = [rng.integers(0, 50_257, n).astype(np.uint16) for n in (700_001, 5, 300_000)]
    parts[0][::1000] = 7
    content = b"".join(wavelet.pack(np.arange(2), np.array([3, len(p) - 3]), p, levels) + b"\n" for p in parts)
    whole, taken = np.concatenate(parts), []
    file = wavelet.TokenFile(lambda at, n: taken.append(n) or content[at : at + n], len(content))
    assert len(file) == len(whole)
    assert [file.access(i) for i in (0, 700_000, 700_001, 700_006, 1_000_005)] == whole[[0, 700_000, 700_001, 700_006, 1_000_005]].tolist()
    places = np.flatnonzero(whole == 7)
    assert file.count(7) == len(places) and (file.occurrences(7) == places).all()
    assert [file.select(7, n) for n in (0, 699, len(places) - 1)] == places[[0, 699, -1]].tolist()
    assert file.count(65_535) == 0 == file.count(1 << 20) and not len(file.occurrences(65_535))
    for bad in (lambda: file.access(len(whole)), lambda: file.select(7, len(places)), lambda: file.select(7, -1)):
        with pytest.raises(IndexError):
            bad()
    taken.clear()
    file.access(345_678)
    assert sum(taken) < len(content) / 2 and len(taken) <= 2 * levels
    assert len(wavelet.TokenFile.of(b"")) == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 90, 9000).astype(np.uint16)
    matrix = wavelet.WaveletMatrix.build(ids, 16)
    assert (matrix.decode() == ids).all()
    assert [matrix.access(i) for i in range(0, 9000, 501)] == ids[::501].tolist()
    assert matrix.count(7, 100, 8000) == (ids[100:8000] == 7).sum() and matrix.count(1000) == 0
    assert (matrix.occurrences(7) == np.flatnonzero(ids == 7)).all() and matrix.select(7, 5) == np.flatnonzero(ids == 7)[5]
    assert len(matrix.occurrences(1000)) == 0
    with pytest.raises(IndexError):
        matrix.select(7, 9000)


def test_token_files(spark):
    table = awkward(spark)
    tok = wavelet.encoder(tokenizer_path()).tokenizer
    start, expected = 0, Counter()
    for r in sorted(table.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        expected[r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(map(tuple, wavelet.tokens(table, tokenizer_path()).collect())) == expected
    assert wavelet.tokens(table.where("false"), tokenizer_path()).count() == 0


def test_mixing(spark):
    table, labels, _ = _labelled(spark, 300)
    table = table.union(docs(spark, [(2000 + i, f"en{i}xing en{i + 1}xing", "en") for i in range(200)]))
    rows, names, targets = mixing.mix(table, labels, weights={"en": 0.3, "de": 0.7})
    got = rows.toPandas()
    reached = [float((got.rate * got.n_tokens * got[f"p{i}"]).sum()) for i in range(2)]
    assert names == ["de", "en"] and reached == pytest.approx(targets, rel=1e-5) and (got.rate >= 0).all()
    assert targets[0] / sum(targets) == pytest.approx(0.7)
    mixed = mixing.mixed_documents(table, labels)
    assert mixed.columns == table.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in table.collect()}
    odd = mixing.mixed_domains(awkward(spark), labels).collect()
    assert len(odd) == 7 and all(r.rate >= 0 for r in odd)
    assert mixing.mixed_domains(table.where("false"), labels.where("false")).count() == 0


def test_secrets(spark):
    rng = random.Random(12)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60))
    texts = [
        'Token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "secret=token=abcdefgh12 token=api_key:abcdefghij password : short", "AKIA1234567890ABCD AKIA12", f"é {blob} end",
        "API-KEY api_key='abcdefgh' APIKEY:zzzzzzzz", "thisisalongrunofordinarywordswithoutanyrandomness1", None, "", "deadbeef" * 5,
    ]
    got = secrets.find_secrets(docs(spark, [(i, t, "en") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for row, text in zip(got, texts, strict=True):
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        plain = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert row.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
    assert got[3].spans == "random:2:62" and got[5].spans == ""
    assert secrets.find_secrets(awkward(spark)).count() == 8 and secrets.find_secrets(awkward(spark).where("false")).count() == 0


def test_step_up_limit_is_exact(spark):
    rng = random.Random(21)
    values = {0: [6e-7] * 3 + [rng.uniform(0.5, 1) for _ in range(997)], 1: [rng.random() ** 6 for _ in range(500)], 2: [1.0] * 50, 3: [0.0, 0.9]}
    rows = [(k, p) for k, ps in values.items() for p in ps]
    limits = secrets.rejection_limits(spark.createDataFrame(rows, "family int, p double"))
    for k, ps in values.items():
        last = max((r for r, p in enumerate(sorted(ps), 1) if p <= secrets.FDR * r / len(ps)), default=0)
        assert sorted(p for p in ps if p <= limits[k]) == sorted(ps)[:last]
    assert sum(p <= limits[0] for p in values[0]) == 3
    assert secrets.rejection_limits(spark.createDataFrame([], "family int, p double")) == {}


def battery_by_hand(token):
    """Encoding, length class and combined p-value of a run, in plain Python."""
    bare = token.rstrip("=").replace("-", "+").replace("_", "/")
    k = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", bare) else 32 if re.fullmatch("[A-Z2-7]+", bare) else 64
    v = [secrets.ALPHABETS[k].find(c) for c in (bare.lower() if k == 16 else bare)]
    n, tail = len(v), lambda z: math.erfc(min(z, 30) / math.sqrt(2)) / 2
    whole = {64: 52, 32: 26}.get(k) if bare.isalpha() and k != 16 else k
    chi = whole * sum(c * c for c in Counter(v).values()) / n - n
    cube = ((max(chi, 1e-9) / (whole - 1)) ** (1 / 3) - (1 - 2 / (9 * (whole - 1)))) / math.sqrt(2 / (9 * (whole - 1)))
    high = [x >= whole / 2 for x in v]
    ones, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean_runs = 1 + 2 * ones * (n - ones) / n
    z_runs = 8 if ones in (0, n) else abs(runs - mean_runs) / math.sqrt(max((mean_runs - 1) * (mean_runs - 2) / (n - 1), 1e-9))
    mean = sum(v) / n
    serial = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False)) / max(sum((x - mean) ** 2 for x in v), 1e-9)
    cell = lambda c: "digit" if not c.isalpha() else ("letter" if k == 16 else ("V" if c.upper() in "AEIOU" else "C") + ("low" if c.islower() else "up"))
    seen = Counter(map(cell, bare))
    size = {16: {"digit": 10, "letter": 6}, 32: {"Vup": 5, "Cup": 21, "digit": 6}, 64: {"Vup": 5, "Cup": 21, "Vlow": 5, "Clow": 21, "digit": 12}}[k]
    if k != 16 and not seen["digit"]:
        del size["digit"]
    merged = []
    for join in (lambda c: c[1:] if c[0] in "VC" else c, lambda c: c):
        own, whole = Counter(), Counter()
        for c, x in size.items():
            own[join(c)] += seen[c]
            whole[join(c)] += n * x / sum(size.values())
        df = len(whole) - 1
        if df:
            chi = sum((own[c] - e) ** 2 / e for c, e in whole.items())
            merged.append(tail(((max(chi, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))))
    p = min(tail(cube), *merged, 2 * tail(z_runs), 2 * tail(abs((serial + 1 / n) * math.sqrt(n))))
    kind, edge = 0, 1.5 * secrets.RUN
    while n >= edge:
        kind, edge = kind + 1, edge * (4 / 3 if kind % 2 == 0 else 1.5)
    return k, kind, min(1.0, 5 * p)


def test_random_spans_equal_brute_force(spark):
    rng, texts = random.Random(27), []
    letters = [*secrets.ALPHABETS.values(), "abcdefgh", "ABCDEFGHIJ234", "0123456789", "etaoinshrdlu"]
    for _ in range(250):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([3, 8, 15, 16, 17, 20, 23, 24, 25, 31, 32, 40, 47, 48, 64, 100]))) + rng.choice(["", "", "=", "=="]) for alphabet in rng.choices(letters, k=6)]
        texts.append(" é ".join(parts))
    texts.append(" ".join("".join(rng.choice(letters[2]) for _ in range(20)) for _ in range(3 * secrets.FOLD + 7)))  # many matches in one text
    near = ["token=", "x", "AKIA", "zz" + "0" * 32, " ", "/", "secret: ", '"']  # base spans beside and within runs, many in one text
    texts.append("".join(rng.choice(near) + "".join(rng.choice(letters[rng.choice([1, 2])]) for _ in range(rng.randint(4, 30))) + rng.choice(" /é,") for _ in range(1200)))
    assign = re.compile(secrets.ASSIGN.replace("(?i:(password|passwd|secret|token|api_?key))", "(password|passwd|secret|token|api_?key)"), re.I | re.A)
    found, families = [], {}
    for i, text in enumerate(texts):
        base = [m.span() for m in assign.finditer(text) if len(m[2]) >= 8] + [m.span() for m in re.finditer("[0-9a-f]{32,}", text)]
        base += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
            if len(m[0].rstrip("=")) >= 16 and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, b in base):
                *family, p = battery_by_hand(m[0])
                found.append((i, m.start(), m.end(), tuple(family), p))
                families.setdefault(tuple(family), []).append(p)
    limit = {}
    for family, ps in families.items():
        limit[family] = max((secrets.FDR * r / len(ps) for r, p in enumerate(sorted(ps), 1) if p <= secrets.FDR * r / len(ps)), default=-1.0)
    expected = {(i, a, b) for i, a, b, family, p in found if p > limit[family]}
    got = set()
    for r in secrets.find_secrets(docs(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect():
        got |= {(r.doc_id, int(x.split(":")[1]), int(x.split(":")[2])) for x in r.spans.split(",") if x.startswith("random:")}
    assert got == expected and len(families) > 10 and 100 < len(expected) < len(found)


def test_random_keys_are_found_at_any_length_and_share(spark):
    rng = random.Random(22)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "er", "ing", "o", "tion", "al", "is")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([2, 3])))
    camel = lambda: "".join(word().title() for _ in range(5))
    slug = lambda: "-".join([*(word() for _ in range(5)), str(rng.randrange(2000, 2030))])
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    mixed, free = secrets.ALPHABETS[64][:62], secrets.ALPHABETS[64][:52]
    kinds = [(mixed, 24, 100), (mixed, 40, 100), (mixed, 64, 100), (free, 40, 60), (secrets.ALPHABETS[32], 40, 60)]
    rows = [(f"{i} {n}", key(letters, n)) for i, (letters, n, count) in enumerate(kinds) for _ in range(count)]
    rows += [("prose", make()) for make in (camel, slug) for _ in range(1500)]
    table = docs(spark, [(i, f"see {t} there", "en") for i, (_, t) in enumerate(rows)])
    found, total = Counter(), Counter(name for name, _ in rows)
    for r in secrets.find_secrets(table).collect():
        found[rows[r.doc_id][0]] += r.n_random
    share = {name: found[name] / n for name, n in total.items()}
    assert all(x >= 0.93 for name, x in share.items() if name != "prose") and share["prose"] < 0.1
    line = docs(spark, [(1, "=" * 60, "en"), (2, "-" * 60, "en"), (3, "Az" + "=" * 30, "en"), (4, "1234567890" * 3, "en")])
    assert {r.n_random for r in secrets.find_secrets(line).collect()} == {0}


def test_words_are_no_spans_and_keys_are_found(spark):
    """Precision and recall over all words of the documents, and planted keys of 24 letters."""
    rng, data = random.Random(31), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {w for r in data.select("text").collect() for w in re.findall(r"[A-Za-z]{16,}", r.text or "") if w[1:].islower()}
    heads, tails = ["Donau", "Gesell", "Wirt", "Land", "ver", "Unter"], ["dampfschiffahrt", "schaftsordnungen", "wirtschaftsministerium", "verschlechterung", "nehmensberatungen"]
    words |= {a + b for a in heads for b in tails} | {"internationalization", "counterrevolutionary", "INTERNATIONALIZATION", "telecommunications", "characteristically", "interdisciplinary"}
    keys = ["".join(rng.choice(secrets.ALPHABETS[64][:62]) for _ in range(24)) for _ in range(300)]
    rows = [(i, f"the {t} of", "en") for i, t in enumerate([*sorted(words), *keys])]
    found = {r.doc_id for r in secrets.find_secrets(docs(spark, rows)).collect() if r.n_random}
    assert not {rows[i][1] for i in found if i < len(words)} - {"the INTERNATIONALIZATION of"}
    assert len([i for i in found if i >= len(words)]) >= 0.97 * len(keys)


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(23)
    items = [(k, prose(rng, n)) for k, n in enumerate([38, 38, 8, 7, 60, 5, 3])]
    rows, expected = [], {}
    for k, item in items:
        own = item.split()
        for cut in range(1, len(own)):
            for text in (own[:-cut], own[cut:], [*own[: len(own) // 2], *own[len(own) // 2 + cut :]]):
                rows.append((len(rows), " ".join(text), "en"))
    for i, text, _ in rows:
        for k, item in items:
            a, b = words(text), words(item)
            n = min(5, len(b))
            bag = lambda x, n=n: Counter(tuple(x[j : j + n]) for j in range(len(x) - n + 1))
            windows = [a] if len(a) < len(b) else [a[s : s + len(b)] for s in range(len(a) - len(b) + 1)]
            both = [((bag(w) & bag(b)).total(), bag(w).total() + bag(b).total()) for w in windows]
            best = max(x / (y - x) for x, y in both)
            if best >= 0.75:
                expected[i, k] = best
    assert expected[0, 0] == 33 / 34 and {k for _, k in expected} == {0, 1, 2, 4}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_passages(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(expected)
    assert decontam.drop_contaminated(docs(spark, rows), bench).count() == len(rows) - len({i for i, _ in expected})


def test_toxicity_scores_equal_plain_convolution(spark):
    """The score of every text, by loops over windows, filters and words, from the same weights."""
    table, labels, _ = _labelled(spark, 300)
    table = table.union(awkward(spark)).union(docs(spark, [(990, "eins", "de"), (991, "a . b", "en"), (991, "a . b", "en")]))
    model = toxicity.train(table, labels)

    def by_hand(text):
        vectors = [sum((model.embed[i].astype(float) for i in toxicity._pieces(w)), np.zeros(toxicity.DIM)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        out = float(model.bias)
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0  # a window may run past the end, where it sees nothing
                for i in range(len(vectors)):
                    best = max(best, sum(float(v @ model.filters[k][j][:, f]) for j, v in enumerate(vectors[i : i + width])))
                out += best * float(model.out[k * toxicity.FILTERS + f])
        return 1 / (1 + math.exp(-(model.scale * out + model.shift)))

    rows = [(r.text, r.lang) for r in table.orderBy("doc_id", "text").collect() if len(r.text or "") < 10_000]
    scored, value, mark = toxicity.score(table, model)
    got = [r for r in scored.orderBy("doc_id", "text").collect() if len(r.text or "") < 10_000]
    assert [r[value] for r in got] == pytest.approx([by_hand(t) for t, _ in rows], abs=1e-5)
    assert all(r[mark] == (r[value] >= model.thresholds.get(r.lang, toxicity.THRESHOLD)) for r in got)


def test_toxicity_sees_all_of_a_run_without_blanks(spark):
    rng = random.Random(41)
    table, labels, _ = _labelled(spark)
    model = toxicity.train(table, labels)
    letters = lambda n: "".join(rng.choice("bcdfghklmnpqrtvwxz") for _ in range(n))
    clean = [letters(400) for _ in range(8)]
    rows = [(i, t, "en") for i, t in enumerate([*clean, *(f"{c[:200]}scumbag{c[200:]}" for c in clean)])]
    rows += [(90, "a\u00a0b\u3000" + "漢字" * 300, "en"), (91, "漢" * 39 + "x", "en"), (92, letters(41), "en"), (93, letters(40) + " " + letters(100_000), "en")]
    scored, value, _ = toxicity.score(docs(spark, rows), model)
    got = {r.doc_id: r[value] for r in scored.collect()}
    assert len(got) == len(rows) and sum(got[i + 8] > got[i] for i in range(8)) >= 7


def test_runs_are_spread_over_their_characters():
    from chunkwell.llm._features import spread_words

    texts = ["short words", "x" * 40, "y" * 41 + " end", None, "", "é" * 30 + "z", "漢字" * 20, "last"]
    words = spread_words(_split(texts))
    got = [[words.text(i) for i in range(words.ptr[k], words.ptr[k + 1])] for k in range(len(texts))]
    grams = lambda t: [t[i : i + 8] for i in range(len(t))]
    assert got == [["short", "words"], ["x" * 40], [*grams("y" * 41), "end"], [], [], grams("é" * 30 + "z"), grams("漢字" * 20), ["last"]]
    again = _split([" ".join(x) for x in got if x])
    assert words.hash.tolist() == again.hash.tolist()


def _split(texts):
    from chunkwell.llm._shared import split_words

    return split_words(pa.array(texts, pa.string()), fold=False)


def test_toxicity_gradients_lower_the_loss_and_thresholds_are_best(spark):
    rng = np.random.default_rng(12)
    score, label = rng.random(400), rng.random(400)
    label = (label < score).astype(float)
    lang = np.array(["a"] * 200 + ["b"] * 190 + ["c"] * 10, dtype=object)
    found = toxicity._thresholds(score, label, lang, np.ones(400))
    assert set(found) == {"a", "b"}
    for one, limit in found.items():
        s, y = score[lang == one], label[lang == one]
        f1 = lambda t, s=s, y=y: 2 * ((s >= t) * y).sum() / ((s >= t).sum() + y.sum())
        inside = [t for t in s if toxicity.LIMITS[0] < t < toxicity.LIMITS[1]]
        assert f1(limit) >= max(map(f1, inside)) - 1e-9 or limit in toxicity.LIMITS


def test_languages_equal_plain_forward_backward(spark):
    """The shares of every text, word after word over the whole text, from the same weights."""
    table, *_ = _labelled(spark, 200)
    field = langid.train(table)
    rng = random.Random(33)
    long = " ".join(rng.choice(["en5xing", "de7xung", "12", "mixed"]) for _ in range(langid.BLOCK * 3 + 17))
    rows = docs(spark, [(1, long, None), (2, "en1xing de2xung", None), (2, "en1xing de2xung", None), (3, "... 12", None), (4, None, None), (5, "a" * 3000, None)])
    features, a = langid.Features(field.lexicon), np.exp(field.moves)

    def by_hand(text):
        e = []
        for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            ids, _ = features([w])
            if len(ids):
                total = field.weights[ids].sum(axis=0)
                e.append(np.exp(total - total.max()))
        if not e:
            return "und", 0.0
        ahead, back = [e[0] / e[0].sum()], [np.ones(len(field.names))]
        for x in e[1:]:
            ahead.append((ahead[-1] @ a) * x)
            ahead[-1] /= ahead[-1].sum()
        for x in e[:0:-1]:
            back.append(a @ (back[-1] * x))
            back[-1] /= back[-1].sum()
        mass = [p * q / (p * q).sum() for p, q in zip(ahead, back[::-1], strict=True)]
        share = np.mean(mass, axis=0)
        return field.names[int(share.argmax())], float(share.max())

    got = sorted(langid.identify(rows, field).collect(), key=lambda r: r.doc_id)
    expected = [by_hand(r.text) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]
    assert [r.lang_pred for r in got] == [x for x, _ in expected]
    assert [r.score for r in got] == pytest.approx([x for _, x in expected], abs=1e-9)


def test_mixing_equals_brute_force(spark):
    """Posteriors by counting words in Python, rates by the same steps in numpy."""
    table, labels, _ = _labelled(spark, 120)
    extra = [(500 + i, f"de{i}xung en{i}xing x", None) for i in range(30)] + [(600, None, "en"), (601, " ", "de"), (7, "en9xing", "en"), (7, "en9xing", "en")]
    table = table.union(docs(spark, extra))
    weights = {"en": 0.25, "de": 0.75}
    rows, names, targets = mixing.mix(table, labels, weights=weights)
    got = {r.doc_id: r for r in rows.collect()}
    bucket = lambda w: (xxhash.xxh64_intdigest(w.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    split = lambda t: [bucket(w) % mixing.BUCKETS for w in re.split("[ \t\n\x0b\x0c\r]", (t or "").lower()) if w]
    given = table.collect()
    marked = {r.doc_id for r in labels.collect()} - {None}
    counts, size = np.zeros((2, mixing.BUCKETS)), np.zeros(2)
    for r in given:
        if r.doc_id in marked and r.lang is not None:
            size[names.index(r.lang)] += 1
            for b in split(r.text):
                counts[names.index(r.lang), b] += 1
    logs = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + mixing.BUCKETS))
    texts = {}
    for r in given:
        texts.setdefault(r.doc_id, []).extend(split(r.text))
    n = np.array([len(texts[i]) for i in got])
    g = np.array([logs[:, texts[i]].sum(axis=1) + np.log(size / size.sum()) for i in got])
    p = np.exp(g - g.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert [(r.n_tokens, r.p0, r.p1) for r in got.values()] == [(int(c), pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9)) for c, (a, b) in zip(n, p, strict=True)]
    totals = n @ p
    want = np.array([weights[x] for x in names])
    target = want * (totals / want).max()
    rate = np.ones(len(n))
    for _ in range(mixing.STEPS):
        error = ((rate * n) @ p - target) / totals.sum()
        if np.abs(error / (totals / totals.sum())).max() < mixing.TOLERANCE:
            break
        rate = np.maximum(rate - p @ (error / (totals / totals.sum())), 0)
    assert targets == pytest.approx(target) and [r.rate for r in got.values()] == pytest.approx(rate, abs=1e-6)


def test_mixing_tells_what_it_cannot_reach(spark, monkeypatch):
    table, labels, _ = _labelled(spark, 60)
    monkeypatch.setattr(mixing, "STEPS", 0)
    with pytest.warns(UserWarning, match="off their targets"):
        mixing.mix(table, labels, weights={"en": 0.1, "de": 0.9})


def test_stages_keep_columns_of_any_name_and_empty_tables(spark):
    table, labels, _ = _labelled(spark, 120)
    names = ["toxic_score", "toxic_rejected", "_id", "_n", "_k", "_own", "_count", "_copy", "_bucket", "_bits", "_key"]
    wide = table.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    bench = spark.createDataFrame([(1, "no such words in any of these texts")], "item_id long, text string")
    stages = {
        "toxicity": lambda d: toxicity.drop_toxic(d, labels), "near": minhash.one_of_each_group,
        "decontamination": lambda d: decontam.drop_contaminated(d, bench), "mixing": lambda d: mixing.mixed_documents(d, labels),
    }
    for name, stage in stages.items():
        left = stage(wide).collect()
        assert left and all(r[n] == f"{n}:{r.doc_id}" for r in left for n in names), name
        assert stage(wide).columns == wide.columns and stage(wide.where("false")).count() == 0, name
        odd = stage(awkward(spark)).collect()
        assert {r.doc_id for r in odd} >= {1, 2, 3, 4, 5, 6, None}, name
    twice = docs(spark, [(None, "the same words here", "en"), (None, "the same words here", "en"), (3, "x", "en"), (3, "x", "en")])
    assert sorted((r.doc_id or 0) for r in minhash.one_of_each_group(twice).collect()) == [0, 0, 3]


def test_samples_are_bounded(spark):
    from chunkwell.llm._shared import hash_sample

    rows = spark.range(20_000).withColumn("hot", F.lit(1))
    assert 700 < hash_sample(rows, 20_000, 1000, "id").count() <= 1000
    assert hash_sample(rows, 20_000, 1000, "hot").count() in (0, 1000)  # one key has all rows
    assert hash_sample(rows.limit(10), 10, 1000, "id").count() == 10


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Words that mark few rows each are all learned, whatever the size of a shard; a sample of the rows missed most of them."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 60, raising=False)
    monkeypatch.setattr(toxicity, "SHARD", 150, raising=False)
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(1200):
        words = [f"plain{rng.randrange(40)}" for _ in range(8)]
        if i % 3 == 0:
            words[3] = f"{'abcdefghij'[i // 3 % 10] * 2}{'klmnopqrst'[i // 30 % 10] * 2}bad"
        rows.append((i, " ".join(words), "en"))
        marks.append((i, 1, int(i % 3 == 0)))
    table = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = toxicity.toxicity(table, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    learned = [(r.score, r.doc_id % 3 == 0) for r in got if not r.held_out]
    low, high = max(s for s, y in learned if not y), sorted(s for s, y in learned if y)
    assert sum(s > low for s in high) >= 0.9 * len(high)


def test_toxicity_orders_hold_each_row():
    label = (np.arange(9000) % 30 == 0).astype(float)
    assert set(np.concatenate(toxicity._order(label, 1)).tolist()) == set(range(9000))


def _shuffled(spark):
    """Bytes that stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_toxicity_shuffles_texts_once_whatever_the_rounds(spark, monkeypatch):
    """Later rounds move states only; before, each round shuffled all texts again."""
    monkeypatch.setattr(toxicity, "SHARD", 100)
    monkeypatch.setattr(toxicity, "STEPS", 40)
    rng, moved = random.Random(8), []
    words = ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(60)]
    table = docs(spark, [(i, " ".join(rng.choice(words) for _ in range(1500)) + " vile" * (i % 3 == 0), "en") for i in range(300)]).repartition(2).cache()
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    table.count()
    for rounds in (2, 6):
        monkeypatch.setattr(toxicity, "ROUNDS", rounds)
        before = _shuffled(spark)
        model = toxicity.train(table, labels)
        moved.append(sum(n for k, n in _shuffled(spark).items() if k not in before))
        assert model.constant is None
    assert moved[0] > 500_000 and moved[1] - moved[0] < 0.5 * moved[0], moved
