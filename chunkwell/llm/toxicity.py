"""Toxic documents by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of hashed vectors of the word and of its beginnings; a run without blanks
that is too long for a word is seen at each of its characters, eight at a time.  Filters of
several widths run over the words of the whole text; each filter's maximum over the text feeds a
logistic output.  It is trained from every labelled row that is not held out: the rows are dealt to shards
of about SHARD rows, whose words are looked up and written once; each shard's task goes on with the common
model in numpy, and after each of ROUNDS rounds the shards' models are averaged, a word's embedding over the
shards that saw it; one shard takes the same path.  A label that is rare has copies of its rows in several shards, about RARE in each.  Of
TUNED_FROM rows or more a fifth only fits the score's scale and, by language, the threshold for
rejection, by counts of all of them at BINS places for each unit of the raw score.  The language chooses a threshold; it is no input of the
score.  A language's threshold is THRESHOLD unless FEWEST rows of each label tune it, and lies
between the bounds in LIMITS.

Defined results: text null, empty or blank has the score of a text that moves no filter; without
labelled rows of both labels every score is the known share of label 1 (0 without labels); labels
that are null are ignored and a document labelled twice has its greater label; a null doc_id is
held out; each input row gives a row, repeated rows too, and ties are rows of equal score; further
columns pass through `drop_toxic` whatever their names.  A very long text is a slice of its own: a
task holds about a hundred bytes for each of its words.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from chunkwell.llm._features import WordFeatures, bucket, spread_words, word_slices
from chunkwell.llm._shared import Words, bound_batches, discard, free_names, held_out, materialise, release_memory, sieved, slices, split_words

SHARD, ROUNDS, RARE, BINS = 16_000, 4, 64, 256
#: Bytes of text from which shards have fewer rows, and that are packed at once.
SHARD_BYTES, PIECE = 64 << 20, 4 << 20
#: States of shards that a task adds up.
ADDED = 16
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
STEPS, BATCH, RATE = 1200, 48, 0.3
START, DROPPED, DECAY = 0.02, 0.5, 1e-3
THRESHOLD, LIMITS = 0.7, (0.3, 0.9)
#: Rows from which a fifth is set aside for tuning, and rows of either label that tune a language.
TUNED_FROM, FEWEST = 200, 20


def _pieces(word: str) -> list[int]:
    word = word.lower().strip("0123456789.,;:!?\"'()[]{}<>*%&$#|_-+=/\\")
    if not word:
        return []
    return [bucket("w", word, BUCKETS)] + [bucket("p", word[:n], BUCKETS) for n in (4, 5, 6, 7) if len(word) >= n]


def _rows(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), 5), dtype=np.int32)
    for row, word in zip(out, words, strict=True):
        own = _pieces(word)
        row[: len(own)] = own
    return out


def features() -> WordFeatures:
    return WordFeatures(5, _rows)


def _layout(codes: np.ndarray, ptr: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with two blanks after each text, and where texts begin there; windows then never meet two texts."""
    gap = max(WIDTHS) - 1
    start = ptr + gap * np.arange(len(ptr))
    out = np.full(int(start[-1]), blank, dtype=np.int64)
    length = np.diff(ptr)
    out[np.arange(len(codes)) + np.repeat(gap * np.arange(len(length)), length)] = codes
    return out, start


class Model:
    """Embeddings, filters and output weights."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, START, (BUCKETS + 1, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.float32(0)
        self.scale, self.shift = 1.0, 0.0
        self.constant: float | None = None
        self.thresholds: dict[str, float] = {}

    def pooled(self, codes: np.ndarray, rows: np.ndarray, ptr: np.ndarray, where: bool = False):  # noqa: ANN201
        """The maximum of every filter over every text, at least 0, and the places that reach it."""
        vectors = np.concatenate([self.embed[rows].sum(axis=1), np.zeros((1, DIM), np.float32)])
        laid, start = _layout(codes, ptr, len(rows))
        length, texts = np.diff(ptr), len(ptr) - 1
        full = np.flatnonzero(length)
        best = np.zeros((texts, FILTERS * len(WIDTHS)), dtype=np.float32)
        places = np.zeros(best.shape, dtype=np.int64)
        for k, w in enumerate(WIDTHS):
            if not len(full):
                break
            total = (vectors @ self.filters[k][0])[laid]
            for j in range(1, w):
                total[:-j] += (vectors @ self.filters[k][j])[laid[j:]]
            # only windows that begin in the text: those that begin in the blanks after it see the next one
            top = np.maximum.reduceat(total, np.stack([start[full], start[full] + length[full]], axis=1).ravel(), axis=0)[::2]
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            best[full, columns] = np.maximum(top, 0)
            if where:
                for i, t in enumerate(full):
                    places[t, columns] = start[t] + total[start[t] : start[t] + length[t]].argmax(axis=0)
        return best, places, vectors, laid

    def raw(self, words: Words, known: WordFeatures) -> np.ndarray:
        best, *_ = self.pooled(*known.of(words), words.ptr)
        return best @ self.out + self.bias

    def score(self, words: Words, known: WordFeatures) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(words.ptr) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(words, known).astype(np.float64) + self.shift, -500, 500)))


def _sums(model: Model) -> dict:
    """Adagrad's sums before the first step."""
    return {
        "embed": np.full(len(model.embed), 1e-3, np.float32), "out": np.full_like(model.out, 1e-3), "bias": 1e-3,
        "filters": [np.full_like(f, 1e-3) for f in model.filters],
    }


def _order(label: np.ndarray, seed: int) -> list[np.ndarray]:
    """The rows of each label in the order of all steps: permutation after permutation, so that each row is used, by more steps than STEPS if need be."""
    rng, sides = np.random.default_rng(seed), [np.flatnonzero(label == y) for y in (0, 1)]
    most = max(STEPS * (BATCH // 2), *map(len, sides))
    return [np.concatenate([rng.permutation(side) for _ in range(-(-most // len(side)))])[:most] for side in sides]


def _fit(model: Model, codes: np.ndarray, rows: np.ndarray, ptr: np.ndarray, label: np.ndarray, seed: int = 11, sums: dict | None = None, part: int = 0, parts: int = 1) -> None:
    """Adagrad on the log loss over batches with as many of each label; the gradient of a maximum goes to its place.  Of all steps those of one of some parts."""
    sums = _sums(model) if sums is None else sums
    slow, order = sums["filters"], _order(label, seed)
    steps, rng = -(-len(order[0]) // (BATCH // 2)), np.random.default_rng([seed, part])
    for at in range(part * steps // parts, (part + 1) * steps // parts):
        pick = np.concatenate([side[at * (BATCH // 2) : (at + 1) * (BATCH // 2)] for side in order])
        words = np.concatenate([codes[ptr[i] : ptr[i + 1]] for i in pick])
        own, local = np.unique(words, return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(ptr[pick + 1] - ptr[pick])))
        stay = rng.random(len(words)) >= DROPPED  # so that no text is told by a single rare word
        local, begin = local[stay], np.concatenate(([0], np.cumsum(stay)))[begin]
        feats = rows[own]
        best, places, vectors, laid = model.pooled(local, feats, begin, where=True)
        wrong = (1 / (1 + np.exp(-(best @ model.out + model.bias))) - label[pick]).astype(np.float32) / len(pick)
        back = (wrong[:, None] * model.out[None, :]) * (best > 0)
        grad_out, grad_bias = best.T @ wrong, wrong.sum()
        grad_v = np.zeros_like(vectors)
        for k, w in enumerate(WIDTHS):
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            g, place = back[:, columns], places[:, columns]
            grad_f = np.zeros_like(model.filters[k])
            for j in range(w):
                word = laid[np.minimum(place + j, len(laid) - 1)] if len(laid) else place
                for f in range(FILTERS):
                    grad_f[j, :, f] = vectors[word[:, f]].T @ g[:, f]
                np.add.at(grad_v, word.ravel(), (g[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIM))
            slow[k] += grad_f**2
            model.filters[k] -= RATE * grad_f / np.sqrt(slow[k])
        touched = np.flatnonzero(np.abs(grad_v[:-1]).sum(axis=1))
        ids = feats[touched]
        use = ids > 0
        spread = np.repeat(grad_v[touched], use.sum(axis=1), axis=0)
        ids, back_to = np.unique(ids[use], return_inverse=True)
        grad_e = np.zeros((len(ids), DIM), np.float32)
        np.add.at(grad_e, back_to, spread)
        sums["embed"][ids] += (grad_e**2).mean(axis=1)
        model.embed[ids] -= RATE * (grad_e / np.sqrt(sums["embed"][ids])[:, None] + DECAY * model.embed[ids])
        sums["out"] += grad_out**2
        sums["bias"] += grad_bias**2
        model.out -= RATE * (grad_out / np.sqrt(sums["out"]) + 1e-3 * model.out)
        model.bias -= np.float32(RATE * grad_bias / np.sqrt(sums["bias"]))


def _scale(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic scale and shift of raw outputs, weighted to the labels' true shares, by damped Newton steps."""
    x, beta = np.stack([raw, np.ones_like(raw)], axis=1).astype(np.float64), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 0.1 * (beta - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return float(max(beta[0], 0.05)), float(beta[1])


def _thresholds(score: np.ndarray, label: np.ndarray, lang: np.ndarray, weight: np.ndarray, rows: np.ndarray | None = None) -> dict[str, float]:
    """By language the middle of the scores between which F1 is greatest; THRESHOLD where labels are few.  A score may stand for several rows, whose weight it has."""
    out: dict[str, float] = {}
    rows = np.ones(len(score)) if rows is None else rows
    for one in sorted({x for x in lang.tolist() if x is not None}):
        at = lang == one
        s, y, w, n = score[at], label[at], weight[at], rows[at]
        if (n * y).sum() < FEWEST or (n * (1 - y)).sum() < FEWEST:
            continue
        order = np.argsort(-s, kind="stable")
        s, hit, miss = s[order], np.cumsum((w * y)[order]), np.cumsum((w * (1 - y))[order])
        f1 = 2 * hit / (hit + miss + hit[-1])
        best = int(f1.argmax())
        below = s[best + 1] if best + 1 < len(s) else 0.0
        out[one] = float(np.clip((s[best] + below) / 2, *LIMITS))
    return out


def _tunes(ids: np.ndarray, total: int) -> np.ndarray:
    """The rows that only tune, a fifth of them if there are enough."""
    return (ids * 2654435761 % (1 << 32) % 5 == 0) & (total >= TUNED_FROM)


State = dict[str, np.ndarray]


def _state(model: Model, sums: dict) -> State:
    """All that training changes, as arrays."""
    own = {f"filter{k}": f for k, f in enumerate(model.filters)} | {f"slow{k}": f for k, f in enumerate(sums["filters"])}
    return own | {"embed": model.embed, "embed_sum": sums["embed"], "out": model.out, "out_sum": sums["out"], "bias": np.array([model.bias, sums["bias"]], np.float32)}


def _restored(state: State) -> tuple[Model, dict]:
    model, state = Model(), {n: a.copy() for n, a in state.items()}
    widths = range(len(WIDTHS))
    model.embed, model.out, model.bias, model.filters = state["embed"], state["out"], state["bias"][0], [state[f"filter{k}"] for k in widths]
    return model, {"embed": state["embed_sum"], "out": state["out_sum"], "bias": state["bias"][1], "filters": [state[f"slow{k}"] for k in widths]}


def _packed(total: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text, lang, toxic, copy, shard) of a shard to one for each PIECE bytes of text, their words as numbers: all that training and tuning need of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = features()
        for batch in (b for whole in batches for b in slices(whole, "text", PIECE)):
            words = spread_words(split_words(batch.column("text"), fold=False))
            codes, rows = known.of(words)
            ids = batch.column("doc_id").to_numpy()
            piece = {
                "codes": codes.astype(np.int32), "rows": rows, "ptr": words.ptr, "id": ids, "label": batch.column("toxic").to_numpy().astype(np.float64),
                "tunes": _tunes(ids, total), "first": batch.column("copy").to_numpy() == 0, "lang": batch.column("lang").to_pylist(),
            }
            del words, codes, rows
            yield pa.RecordBatch.from_arrays([batch.column("shard").slice(0, 1), pa.array([_pressed(piece)], pa.binary())], names=["shard", "value"])
            del piece

    return pack


def _pressed(piece: dict) -> bytes:
    """A piece as few bytes, since the JVM holds all of a shard's at once."""
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "zstd") as stream:
        pickle.dump(piece, stream, protocol=5)
    return out.getvalue().to_pybytes()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    for batch in batches:
        for n, value in zip(batch.column("shard").to_pylist(), batch.column("value"), strict=True):
            with pa.CompressedInputStream(pa.BufferReader(value.as_buffer()), "zstd") as stream:
                yield n, pickle.load(stream)


def _joined(pieces: Iterator[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, rows of words, first words and labels of the texts to learn from, in an order that does not depend on how they came; of each piece only these are kept."""
    keys, parts, rows, base = [], [], [], 0
    for piece in pieces:
        for t in np.flatnonzero(~piece["tunes"]):
            codes = piece["codes"][piece["ptr"][t] : piece["ptr"][t + 1]]
            keys.append((piece["id"][t], piece["rows"][codes].sum(), piece["label"][t]))
            parts.append(codes + np.int32(base))
        rows.append(piece["rows"])
        base += len(piece["rows"])
    order = sorted(range(len(keys)), key=keys.__getitem__)
    codes = np.concatenate([np.zeros(0, np.int32), *(parts[k] for k in order)])
    return codes, np.concatenate(rows), np.cumsum([0, *(len(parts[k]) for k in order)]), np.array([keys[k][2] for k in order])


def _learned(given: Broadcast[State], part: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed shards to their states after some steps; embeddings of words a shard did not see are 0 and `seen` marks the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, pieces in groupby(_unpacked(batches), key=lambda x: x[0]):
            codes, rows, ptr, label = _joined(p for _, p in pieces)
            if len(set(label.tolist())) < 2:
                continue
            release_memory()
            state = given.value
            model, sums = _restored(state)
            _fit(model, codes, rows, ptr, label, 11 + n, sums, part, parts)
            out = _state(model, sums)
            seen = (out["embed_sum"] != state["embed_sum"]).astype(np.float32)
            out |= {"embed": np.where(seen[:, None] > 0, out["embed"], np.float32(0)), "embed_sum": out["embed_sum"] * seen, "seen": seen, "shards": np.ones(1)}
            yield pa.RecordBatch.from_arrays([pa.array([n // ADDED], pa.int64()), pa.array([n], pa.int64()), pa.array([pickle.dumps(out)], pa.binary())], names=["n", "shard", "value"])
            del codes, rows, out
            release_memory()

    return run


def _added(parts: pa.Table) -> pa.Table:
    """The sum of at most ADDED states, in the order of their shards."""
    out: State = {}
    for value in parts.sort_by("shard").column("value"):
        for name, array in pickle.loads(value.as_buffer()).items():
            out[name] = out[name] + array if name in out else array
    n = parts.column("n")[0].as_py()
    return pa.table({"n": pa.array([n // ADDED], pa.int64()), "shard": pa.array([n], pa.int64()), "value": pa.array([pickle.dumps(out)], pa.binary())})


def _averaged(before: State, total: State) -> State:
    """The mean of the shards' states; a word's embedding is the mean of those that saw it, or stays."""
    out = {n: (a / total["shards"][0]).astype(np.float32) for n, a in total.items() if n not in ("embed", "embed_sum", "seen", "shards")}
    seen, times = total["seen"] > 0, np.maximum(total["seen"], 1)
    return out | {"embed": np.where(seen[:, None], total["embed"] / times[:, None], before["embed"]), "embed_sum": np.where(seen, total["embed_sum"] / times, before["embed_sum"])}


def _dealt(rows: DataFrame, there: dict[int, int], size: int) -> tuple[DataFrame, int]:
    """Rows (doc_id, text, lang, toxic), of which so many have each label and whose texts have so many bytes, packed into shards (shard, value); the number of shards."""
    total = sum(there.values())
    shards = max(1, -(-total // SHARD), -(-size // SHARD_BYTES))
    copies = F.when(F.col("toxic") == 1, F.lit(min(shards, -(-shards * RARE // max(1, there.get(1, 0)))))).otherwise(F.lit(min(shards, -(-shards * RARE // max(1, there.get(0, 0))))))
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text") + F.col("copy"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(_packed(total), "shard long, value binary")
    return materialise(packed, "toxicity-shards", "shard", compression="none", **{"parquet.block.size": 1 << 30}), shards  # one file and block for each, so that a task reads all of it


def _rounds(packed: DataFrame, shards: int) -> State | None:
    """The state after all rounds over packed shards; None where no shard has both labels to learn from.  Only states are shuffled."""
    model = Model()
    state, context = _state(model, _sums(model)), packed.sparkSession.sparkContext
    for part in range(ROUNDS):
        given, left = context.broadcast(state), shards
        found = packed.mapInArrow(_learned(given, part, ROUNDS), "n long, shard long, value binary")
        while True:
            found, left = found.groupBy("n").applyInArrow(_added, "n long, shard long, value binary"), -(-left // ADDED)
            if left == 1:
                break
        got = found.select("value").collect()  # one state
        given.destroy()
        if not got:
            return None
        state = _averaged(state, pickle.loads(got[0]["value"]))
    return state


def _tuned(model: Model, packed: DataFrame, share: dict[int, int], total: int) -> None:
    """Fit the scale and thresholds to counts of the tuning rows, of which at most some thousands for each language reach the driver."""
    given = packed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _unpacked(batches):
            use = np.flatnonzero(held["first"] & (held["tunes"] | (total < TUNED_FROM)))
            parts = [held["codes"][held["ptr"][t] : held["ptr"][t + 1]] for t in use]
            own, local = np.unique(np.concatenate([np.zeros(0, np.int32), *parts]), return_inverse=True)
            best, *_ = given.value.pooled(local, held["rows"][own], np.cumsum([0, *map(len, parts)]))
            lang, raw = pa.array([held["lang"][t] for t in use], pa.string()), best @ given.value.out + given.value.bias
            yield pa.RecordBatch.from_arrays([lang, pa.array(held["label"][use].astype(np.int32)), pa.array(raw, pa.float64())], names=["lang", "toxic", "raw"])
            release_memory()

    raws = packed.mapInArrow(run, "lang string, toxic int, raw double")
    bins = raws.groupBy("lang", "toxic", F.floor(F.col("raw") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.avg("raw").alias("raw"))
    found = sorted(bins.collect(), key=lambda r: (r["lang"] or "", r["toxic"], r["bin"]))
    given.destroy()
    if not found:
        return
    raw, y, n = (np.array([r[c] for r in found], dtype=np.float64) for c in ("raw", "toxic", "n"))
    weight = n * np.where(y == 1, share.get(1, 0) / max(1, (n * y).sum()), share.get(0, 0) / max(1, (n * (1 - y)).sum()))
    model.scale, model.shift = _scale(raw, y, weight * n.sum() / weight.sum())
    score = 1 / (1 + np.exp(-(model.scale * raw + model.shift)))
    model.thresholds = _thresholds(score, y, np.array([r["lang"] for r in found], dtype=object), weight, n)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit a model to every labelled row that is not held out, in shards; only models and counts reach the driver."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(~held_out("_id"))
    share = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    known, positive = sum(share.values()), share.get(1, 0)
    constant = Model()
    constant.constant = positive / known if known else 0.0
    if not positive or positive == known:
        return constant
    bound_batches(documents.sparkSession)
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string").alias("lang")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang, F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    rows, labelled = rows.where(~held_out("doc_id")), F.col("doc_id") == F.col("_id")
    counts = rows.join(marks.hint("merge"), labelled).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    rows = sieved(rows, "doc_id", marks.select("_id")).join(marks.hint("merge"), labelled)  # so that of texts without a label few are shuffled
    there = {r["toxic"]: r["n"] for r in counts}
    if len(there) < 2:
        return constant
    packed, shards = _dealt(rows.select("doc_id", "text", "lang", "toxic"), there, sum(r["bytes"] for r in counts))
    state = _rounds(packed, shards)
    if state is None:
        discard(packed)
        return constant
    model, _ = _restored(state)
    _tuned(model, packed, share, sum(there.values()))
    discard(packed)
    release_memory()
    return model


def score(documents: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    """All columns of documents and two more, the score and whether it is rejected; the names of these two."""
    bound_batches(documents.sparkSession)
    given = documents.sparkSession.sparkContext.broadcast(model)
    names, (value, mark) = documents.columns, free_names(documents, "toxic_score", "toxic_rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = given.value, features()
        for batch, words in word_slices(batches, spread=True):
            p = model.score(words, known)
            lang = batch.column("lang").to_pylist() if "lang" in names else [None] * len(p)
            limit = np.array([model.thresholds.get(x, THRESHOLD) for x in lang])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(p >= limit)], names=[*names, value, mark])

    schema = StructType([*documents.schema, StructField(value, DoubleType()), StructField(mark, BooleanType())])
    return documents.mapInArrow(run, schema), value, mark


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7), rejected (by its language's threshold)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    scored, value, mark = score(rows, train(rows, labels))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col(value).alias("score"), (F.col(value) >= THRESHOLD).cast("int").alias("predicted"), F.col(mark).alias("rejected")
    )


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below their language's threshold."""
    scored, _, mark = score(documents, train(documents, labels))
    return scored.where(~F.col(mark)).select(*documents.columns)
