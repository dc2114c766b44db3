"""Timestamps, divergence and token counts against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwell.llm import divergence, stamps, tokencount
from chunkwell.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_tokens int, rank int"
STAMPS = "stamp_id long, source string, zone string, raw string, rule string, state int"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _date(y, m, d):
    try:
        return datetime(int(y), int(m), int(d))
    except ValueError:
        return None


def _read(raw):
    """Dates of a stamp in the two orders, seconds, offset or None; or epoch microseconds; or None."""
    t = (raw or "").strip(" \t\n\v\f\r")
    if re.fullmatch(r"[0-9]{10}|[0-9]{13}", t):
        return int(t) * (10**6 if len(t) == 10 else 1000)
    time = r"([T ](?P<h>[0-9]{2}):(?P<mi>[0-9]{2})(:(?P<s>[0-9]{2}))?(\x20?(?P<ap>[AP])M)?(\x20?(?P<z>Z|[+-][0-9]{2}:?[0-9]{2}))?)?"
    for date in (
        r"(?P<y>20[0-9]{2})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})", r"(?P<y>20[0-9]{2})(?P<m>[0-9]{2})(?P<d>[0-9]{2})", r"(?P<d>[0-9]{2})\.(?P<m>[0-9]{2})\.(?P<y>20[0-9]{2})",
        rf"(?P<d>[0-9]{{2}}) (?P<m>{'|'.join(MONTHS)}) (?P<y>20[0-9]{{2}})", r"(?P<a>[0-9]{2})/(?P<b>[0-9]{2})/(?P<y>20[0-9]{2})",
    ):
        m = re.fullmatch(date + time, t)
        if not m:
            continue
        g = m.groupdict()
        if "a" in g:
            both = [_date(g["y"], g["b"], g["a"]), _date(g["y"], g["a"], g["b"])]
        else:
            both = [_date(g["y"], MONTHS.index(g["m"]) + 1 if g["m"] in MONTHS else g["m"], g["d"]), None]
        h, mi, s = int(g["h"] or 0), int(g["mi"] or 0), int(g["s"] or 0)
        if mi > 59 or s > 59 or (not 1 <= h <= 12 if g["ap"] else h > 23):
            return None
        h = h % 12 + 12 * (g["ap"] == "P") if g["ap"] else h
        off = None
        if g["z"]:
            z = g["z"].replace(":", "")
            off = 0 if z == "Z" else (int(z[1:3]) * 3600 + int(z[3:]) * 60) * (-1 if z[0] == "-" else 1)
            if z != "Z" and (int(z[1:3]) > 14 or int(z[3:]) > 59):
                return None
        return [(d + timedelta(hours=h, minutes=mi, seconds=s), off) if d else None for d in both] if any(both) else None
    return None


def _utc(wall, off, zone):
    """UTC seconds, and whether the wall time is skipped or repeated; the first fold is the offset before the change."""
    seconds = int(wall.replace(tzinfo=UTC).timestamp())
    if off is not None:
        return seconds - off, False
    first, second = (int(wall.replace(tzinfo=ZoneInfo(zone), fold=f).utcoffset().total_seconds()) for f in (0, 1))
    return seconds - first, first != second


def expected_stamps(rows):
    """By brute force: each row's (stamp_id, utc_us, rule, ambiguous)."""
    known = {"UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Africa/Casablanca", "Australia/Lord_Howe"}
    parsed, votes = [], Counter()
    for i, source, zone, raw in rows:
        x = _read(raw)
        if isinstance(x, list):
            x = [_utc(*d, zone) if d and (d[1] is not None or zone in known) else None for d in x]
            slashed = raw.strip(" \t\n\v\f\r")[2] == "/"
            if slashed and sum(d is not None for d in x) == 1:
                votes[source, x[0] is not None] += 1
        parsed.append((i, source, x))
    out = []
    for i, source, x in parsed:
        if isinstance(x, int):
            out.append((i, x, "epoch", False))
        elif not x or not any(x):
            out.append((i, None, "bad", False))
        elif all(x) and x[0] != x[1]:
            day, month = votes[source, True], votes[source, False]
            out.append((i, x[0 if day > month else 1][0] * 10**6, "default" if day == month else "votes", True))
        else:
            utc, unclear = x[0] or x[1]
            out.append((i, utc * 10**6, "plain", unclear))
    return Counter(out)


def random_stamp(rng):
    y, m, d = rng.choice([2000, 2023, 2024, 2099]), rng.choice([1, 2, 3, 10, 12, 13]), rng.choice([1, 2, 5, 12, 13, 27, 29, 30, 31, 0])
    date = rng.choice([f"{y}-{m:02}-{d:02}", f"{y}{m:02}{d:02}", f"{d:02}.{m:02}.{y}", f"{d:02} {MONTHS[m % 12]} {y}", f"{d:02}/{m:02}/{y}", f"{m:02}/{d:02}/{y}"])
    h, mi, s = rng.choice([0, 1, 2, 3, 12, 13, 23, 24]), rng.choice([0, 30, 59, 60]), rng.choice(["", "", ":00", ":59", ":60", ":5"])
    time = rng.choice(["", f"{rng.choice('T ')}{h:02}:{mi:02}{s}{rng.choice(['', '', 'AM', ' PM', ' AM', '  AM', 'pm'])}{rng.choice(['', '', 'Z', ' Z', '+05:30', '-0800', ' +14:59', '+15:00', '+01'])}"])
    return rng.choice(["", "", " ", "\t\n", " "]) + date + time + rng.choice(["", "", "", " ", "x", "\r\n"])


def test_stamps(spark):
    rng = random.Random(11)
    zones = ["UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Africa/Casablanca", "Australia/Lord_Howe", "No/Where", None]
    rows = [(k % 900, rng.choice(["a", "b", "c", None]), rng.choice(zones), random_stamp(rng)) for k in range(6000)]
    rows += [(None, "a", "UTC", None), (1, "d", "UTC", ""), (2, "d", "UTC", "1733025832"), (2, "d", "UTC", "1733025832"), (3, "d", "UTC", "1733025832123"), (4, "d", "UTC", "17330258321")]
    rows += [(5, "e", "UTC", "01/02/2024"), (6, "e", "UTC", "2024-01-01" + "x" * 100_000), (7, "f", "UTC", "13/01/2024"), (8, "f", "UTC", "05/06/2024 10:00"), (9, "f", "UTC", "05/06/2024 10:60")]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], STAMPS)
    got = stamps.normalised(df)
    assert got.dtypes == [("stamp_id", "bigint"), ("utc_us", "bigint"), ("rule", "string"), ("ambiguous", "boolean")]
    assert Counter(map(tuple, got.collect())) == expected_stamps(rows)
    assert stamps.normalised(df.where("false")).count() == 0


@given(st.integers(0, 2**31), st.sampled_from(["Europe/Berlin", "America/Sao_Paulo", "Africa/Casablanca", "Australia/Lord_Howe", "Pacific/Apia", "Asia/Pyongyang"]))
@settings(max_examples=60, deadline=None)
def test_wall_times(seed, zone):
    rng, changes = random.Random(seed), stamps.zone_changes(zone)
    walls = [datetime(2000, 1, 1) + timedelta(seconds=rng.randrange(99 * 365 * 86_400)) for _ in range(20)]
    walls += [datetime(1970, 1, 1) + timedelta(seconds=int(t) + rng.randrange(-90_000, 90_000)) for t in changes[0][:40]]
    walls = [w for w in walls if w.year >= 2000]
    utc, unclear = stamps.to_utc(np.array([int(w.replace(tzinfo=UTC).timestamp()) for w in walls]), changes)
    assert [(int(u), bool(x)) for u, x in zip(utc, unclear, strict=True)] == [_utc(w, None, zone) for w in walls]


# ---------------------------------------------------------------- divergence


def expected_divergence(rows, least, most):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {t[0] for t in terms}:
        own = [t for t in terms if t[0] == lang]
        kept = sorted(w for w, n in Counter(w for _, _, ws in own for w in set(ws)).items() if n >= least)
        counts = {s: Counter(w for _, x, ws in own if x == s for w in ws if w in set(kept)) for s in {t[1] for t in own}}
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 5) // (c.total() + 5 * len(kept))  # noqa: B023, E731
        for s, c in counts.items():
            pairs = sorted((-sum(abs(p(c, w) - p(d, w)) for w in kept), o.encode()) for o, d in counts.items() if o != s)
            own_terms = sorted((p(whole, w) - p(c, w), w.encode()) for w in kept if c[w] and p(c, w) > p(whole, w))[:most]
            for part, items in (("pair", pairs), ("term", own_terms)):
                out |= {(lang, s, part, item.decode(), -f, k) for k, (f, item) in enumerate(items, 1)}
    return out


def test_divergence(spark, monkeypatch):
    rng = random.Random(12)
    pool = ["the", "The", "ÜBER", "über", "naïve", "x1y", "漢字", "_a_", "don't", " b", *(f"w{chr(97 + k)}" for k in range(26))]
    rows = []
    for k in range(400):
        lang, source = rng.choice([("en", "s1"), ("en", "s2"), ("en", "Ünd"), ("de", "s1"), ("de", None), ("", ""), (None, "s9")])
        rows.append((" ".join(rng.choice(pool[k % 7 :]) for _ in range(rng.randrange(12))) or None, lang, source))
    rows += [("one two", "fr", "alone"), (None, "es", "a"), ("", "es", "b"), ("\x00\x00", "es", "a"), ("long " * 50_000 + "end", "en", "s1")]
    df = spark.createDataFrame([(k, *r, 1, 1) for k, r in enumerate(rows)], DOCS)
    monkeypatch.setattr(divergence, "PORTION", 40)
    got = divergence.divergence(df, least=5, terms=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(set(found)) == len(found) and set(found) == expected_divergence(rows, 5, 7)
    assert divergence.divergence(df.where("false")).count() == 0


def test_counts_are_summed_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED", 8)
    held = divergence._Summed()
    for k in range(20):
        held.add(pa.table({"lang": ["a", "a"], "source": ["s", "s"], "term": ["x", f"y{k % 3}"], "docs": [1, 1], "n": [2, 3]}))
    assert sorted(tuple(r.values()) for r in held.take().to_pylist()) == [("a", "s", "x", 20, 40), ("a", "s", "y0", 7, 21), ("a", "s", "y1", 7, 21), ("a", "s", "y2", 6, 18)]
    assert held.take().num_rows == 0


# ---------------------------------------------------------------- token counts

AWKWARD = ["a", "b", "'", "s", "t", "d", "r", "e", "v", "m", "l", "1", ".", "!", " ", "  ", "\n", "\t", " ", "é", "×", "ß", "　", "漢", "٣", "¼", "😀", "‍", "́", "’", "<|endoftext|>", "\r\n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@given(st.lists(st.lists(st.sampled_from(AWKWARD), max_size=25).map("".join) | st.text(max_size=20) | st.none(), max_size=12))
@settings(max_examples=60, deadline=None)
def test_pieces_sum_to_the_librarys_counts(name, texts):
    import public_tokenizers

    cutter = tokencount.cutter(public_tokenizers.path(name))
    cuts = cutter.cut(pa.array(texts, pa.string()))
    each = np.array([cutter.tokens(p) for p in cuts.pieces.to_pylist()], dtype=np.int64)
    got = cuts.extra.copy()
    np.add.at(got, cuts.text, cuts.count * each[cuts.piece])
    plain = [t or "" for t in texts]
    if name.endswith(".model"):
        assert got.tolist() == [len(cutter.model.encode(t)) for t in plain]
    else:
        assert got.tolist() == [len(cutter.tokenizer.encode(t, add_special_tokens=False).ids) for t in plain]


@pytest.mark.parametrize("hot", [0, 3, 1 << 16])
def test_token_counts(spark, hot):
    rng = random.Random(13)
    texts = ["".join(rng.choice(AWKWARD) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "word " * 100_000, "x" * 30_000, "<|endoftext|>" * 600, "same", "same"]
    rows = [(k // 2 if k < 200 else k, t, "en", "s", 1, 1) for k, t in enumerate(texts)] + [(7, "twice", "en", "s", 1, 1)] * 3 + [(None, "no id", "en", "s", 1, 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = tokencount.token_counts(df, tokenizer_path(), hot=hot)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    tok = tokencount.cutter(tokenizer_path()).tokenizer
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    assert Counter(map(tuple, got.collect())) == Counter((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 512) for r in rows)
    assert tokencount.token_counts(df.where("false"), tokenizer_path()).count() == 0


def test_hot_limit(spark):
    pieces = spark.createDataFrame([(9,), (9,), (5,), (3,), (3,), (1,)], "freq long")
    assert [tokencount.hot_limit(pieces, k) for k in (2, 3, 4, 5, 6)] == [9, 5, 5, 3, 1]
    assert tokencount.hot_limit(pieces, 1) > 9 and tokencount.hot_limit(pieces.where(F.lit(False)), 5) > 9


# ---------------------------------------------------------------- components


def test_components_of_stars_paths_and_rings(spark):
    from chunkwell.llm.components import connected_components

    rng = random.Random(14)
    links = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(700)] + [(7000 + k, 7000 + (k + 1) % 60) for k in range(60)] + [(9, 9), (9001, 9001), (9002, 9003), (9003, 9002)]
    rng.shuffle(links)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = dict.fromkeys(range(3000), 0) | dict.fromkeys(range(5000, 5701), 5000) | dict.fromkeys(range(7000, 7060), 7000) | {9001: 9001, 9002: 9002, 9003: 9002}
    assert got == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_rounds_only_where_chunks_disagree(spark, monkeypatch):
    from chunkwell.llm import components

    names, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: names.append(name) or write(df, name))
    links = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1300)] + [(2000, 2000), (2**60 + 1, 2**60)]
    expected = dict.fromkeys(range(301), 0) | dict.fromkeys(range(1000, 1300), 1000) | {2000: 2000, 2**60: 2**60, 2**60 + 1: 2**60}
    for together in ("true", "false"):  # one chunk, or one for each of four partitions
        names.clear()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", together)
        try:
            got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == expected
        assert names[:2] == ["stars", "labels"]
        assert (len(names) == 2) == (together == "true")


def test_least_reachable_equals_a_search():
    import numpy as np

    from chunkwell.llm.components import least_reachable

    rng = np.random.default_rng(5)
    for n in (1, 5, 60, 400):
        a, b = rng.integers(0, n, n // 2 + 1), rng.integers(0, n, n // 2 + 1)
        label = {int(x): int(x) for x in (*a, *b)}
        for _ in range(len(label)):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                label[x] = label[y] = min(label[x], label[y])
        nodes, least = least_reachable(a, b)
        assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == label


def test_near_duplicates_do_not_repeat_a_pass_over_the_same_components(spark, monkeypatch):
    from chunkwell.llm import minhash

    names, write = [], minhash.materialise
    monkeypatch.setattr(minhash, "materialise", lambda df, name: names.append(name) or write(df, name))
    word = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(word)), (2, " ".join([*word[:59], "x"])), (3, " ".join([*word[:58], "y", "z"])), (4, "quite other words stand in this one")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert names.count("labelled") == names.count("apart") == 1
