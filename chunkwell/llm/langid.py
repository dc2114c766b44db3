"""Language of words and texts by a linear-chain conditional random field.

A word's potentials are sums of weights of hashed features: beginnings, endings, all character
bigrams and trigrams, the word itself, and lexicon features of words that the training texts use in
mainly one language; affixes and n-grams are of UTF-8 bytes.  Transitions between languages of
successive words are learnt with them.  Training maximises the conditional likelihood by Adagrad in
one task, from at most TRAIN_ROWS labelled texts.  Both training and labelling run forward-backward
over each whole text, in blocks that hand their messages on, so a text's language is the one with
the greatest expected share of its words, and code-switched texts are labelled word by word.

Defined results: text null or without a letter is `und` with score 0; without any labelled text
every text is `und`; words without a letter carry no evidence and are passed over; ties go to the
language first in order; a null doc_id is held out; each input row gives a row, repeated rows too;
columns other than doc_id, text and lang are ignored.  A very long text is a slice of its own: a
task holds about three hundred bytes for each of its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm._features import WordFeatures, sample, word_slices
from chunkwell.llm._shared import Words, bound_batches, fitted, held_out, mix64, ranges, span_hashes, split_words

TRAIN_ROWS = 2000
BUCKETS, BLOCK, EPOCHS, RATE, BATCH_WORDS = 1 << 16, 256, 3, 0.2, 1 << 14
UNKNOWN = "und"
_EDGES = "0123456789.,;:!?\"'()[]{}<>*%&$#|_-+=/\\@~^`"


class Features:
    """Hashed features of words; a word without a letter has none."""

    def __init__(self, lexicon: dict[str, int]) -> None:
        self.lexicon = lexicon

    @staticmethod
    def bare(word: str) -> str:
        """The letters of a word in lower case."""
        word = word.lower().strip(_EDGES)
        return word if word.isalpha() else "".join(c for c in word if c.isalpha())

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features from 0 to BUCKETS - 1 of all words one after another by kind, and the word of each."""
        plain = [self.bare(w) for w in words]
        parts = [w.encode("utf-8", "replace") for w in plain]
        size = np.array([len(p) for p in parts], dtype=np.int64)
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        end = np.cumsum(size)
        start = end - size
        full = np.flatnonzero(size)
        found = [(span_hashes(raw, start[full], end[full]), full)]
        known = np.array([self.lexicon.get(w, -1) for w in plain], dtype=np.int64)
        listed = np.flatnonzero(known >= 0)
        found.append((known[listed].astype(np.uint64), listed))
        owner = np.repeat(np.arange(len(words)), size)
        code = raw.astype(np.uint64)
        for n in (1, 2, 3):
            if n > 1:
                code = (code[:-1] << np.uint64(8)) | raw[n - 1 :]
            own = np.flatnonzero(size >= n)
            found += [(code[start[own]], own), (code[end[own] - n], own)]
            if n > 1:
                inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
                found.append((code[inside], owner[n - 1 :][inside]))
        ids = np.concatenate([mix64(values * np.uint64(64) + np.uint64(kind)) % np.uint64(BUCKETS) for kind, (values, _) in enumerate(found)])
        return ids.astype(np.int64), np.concatenate([o for _, o in found])


class Field:
    """Weights of features by language, and transition potentials."""

    def __init__(self, names: list[str], lexicon: dict[str, int]) -> None:
        self.names, self.lexicon = names, lexicon
        self.weights = np.zeros((BUCKETS, len(names)), dtype=np.float64)
        self.moves = np.eye(len(names), dtype=np.float64)

    def potentials(self, ids: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """A row for each word, its greatest number 1; zeros for a word without features."""
        total = np.stack([np.bincount(owner, weights=w[ids], minlength=count) for w in self.weights.T], axis=1)
        out = np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -200.0))
        return out * (np.bincount(owner, minlength=count) > 0)[:, None]

    def words(self) -> WordFeatures:
        """Potentials of words, kept."""
        features = Features(self.lexicon)
        return WordFeatures(len(self.names), lambda words: self.potentials(*features(words), len(words)), np.float64)


def _products(e: np.ndarray, start: np.ndarray, length: np.ndarray, opens: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Of each block the matrix that takes the message before it to the message after it, but for a factor."""
    order = np.argsort(-length, kind="stable")
    start, length, opens = start[order], length[order], opens[order]
    m = np.where(opens[:, None, None], 1.0, a[None]) * e[start][:, None, :]
    for t in range(1, int(length[0])):
        n = int(np.searchsorted(-length, -t, side="left"))
        now = (m[:n] @ a) * e[start[:n] + t][:, None, :]
        m[:n] = now / now.sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(m)
    out[order] = m
    return out


def forward_backward(e: np.ndarray, ptr: np.ndarray, moves: np.ndarray, pairs: bool = False, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word of whole texts (rows ptr[i] to ptr[i + 1] of `e`), and the expected number of each transition.

    Texts are cut into blocks that are run side by side.  The product of a block's matrices takes the
    messages on from block to block, forward and backward, so nothing is lost where blocks meet.
    """
    a, out, expected = np.exp(moves - moves.max()), np.zeros_like(e), np.zeros_like(moves)
    size = np.diff(ptr)
    each = -(-size // block)
    nth = ranges(np.zeros(len(each), np.int64), each)
    start = np.repeat(ptr[:-1], each) + block * nth
    if not len(start):
        return out, expected
    length = np.minimum(block, np.repeat(ptr[1:], each) - start)
    first, most = np.cumsum(each) - each, int(each.max())
    before, after = np.full((len(start), e.shape[1]), 1 / e.shape[1]), np.ones((len(start), e.shape[1]))
    if most > 1:
        many = np.flatnonzero(np.repeat(each > 1, each))
        step = np.zeros(len(start), dtype=np.int64)
        step[many] = np.arange(len(many))
        product = _products(e, start[many], length[many], nth[many] == 0, a)
        for j in range(1, most):
            b = (first + j)[each > j]
            now = np.einsum("bi,bij->bj", before[b - 1], product[step[b - 1]])
            before[b] = now / now.sum(axis=1, keepdims=True)
        for j in range(most - 1, 0, -1):
            b = (first + j)[each > j]
            now = np.einsum("bij,bj->bi", product[step[b]], after[b])
            after[b - 1] = now / now.sum(axis=1, keepdims=True)
    order = np.argsort(-length, kind="stable")
    start, length, inner, before, back = start[order], length[order], (nth > 0)[order], before[order], after[order]
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]))]
    ahead = [np.where(inner[:, None], before @ a, 1.0) * e[start]]
    ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
    for t, n in enumerate(live[1:], 1):
        now = (ahead[-1][:n] @ a) * e[start[:n] + t]
        ahead.append(now / now.sum(axis=1, keepdims=True))
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        mass = ahead[t] * back[:n]
        out[start[:n] + t] = mass / mass.sum(axis=1, keepdims=True)
        new = back[:n] * e[start[:n] + t]
        if pairs:
            from_ = ahead[t - 1][:n] if t else before
            both = from_[:, :, None] * a[None] * new[:, None, :]
            both /= both.sum(axis=(1, 2), keepdims=True)
            expected += (both if t else both[inner]).sum(axis=0)
        if t:
            new = new @ a.T
            back[:n] = new / new.sum(axis=1, keepdims=True)
    return out, expected


def _worded(codes: np.ndarray, use: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of which `use` holds, and where each text begins among them."""
    kept = use[codes] if len(use) else np.zeros(0, bool)
    return codes[kept], np.concatenate(([0], np.cumsum(kept)))[ptr]


def _lexicon(words: Words, label: np.ndarray, count: int) -> dict[str, int]:
    """Frequent words that nine in ten of their texts use in one language."""
    seen: dict[str, Counter] = {}
    for i in range(len(label)):
        for w in {words.text(k).lower().strip(".,;:!?") for k in range(words.ptr[i], words.ptr[i + 1])}:
            seen.setdefault(w, Counter())[int(label[i])] += 1
    out = {}
    for w, by in seen.items():
        (top, n), total = by.most_common(1)[0], sum(by.values())
        if total >= max(3, count // 200) and n >= 0.9 * total and w.isalpha():
            out[w] = top
    return out


def _fit(rows: pa.Table) -> Field:
    """Fit a field to rows (text, label)."""
    rows = rows.sort_by([("label", "ascending"), ("text", "ascending")])
    names = sorted(set(rows.column("label").to_pylist()))
    label = np.searchsorted(names, rows.column("label").to_pylist())
    words = split_words(rows.column("text"), fold=False)
    field = Field(names, _lexicon(words, label, len(label)))
    _, distinct, codes = np.unique(words.hash, return_index=True, return_inverse=True)
    ids, owner = Features(field.lexicon)([words.text(k) for k in distinct.tolist()])
    order = np.argsort(owner, kind="stable")
    ids, owner = ids[order], owner[order]
    count = np.bincount(owner, minlength=len(distinct))
    at = np.cumsum(count) - count
    codes, ptr = _worded(codes, count > 0, words.ptr)
    size = np.diff(ptr)
    share = np.bincount(label, weights=size, minlength=len(names))
    slow, slow_moves = np.full(BUCKETS, 1e-2), np.full(field.moves.shape, 1e-2)
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        texts = rng.permutation(np.flatnonzero(size))
        batches = np.split(texts, np.flatnonzero(np.diff(np.cumsum(size[texts]) // BATCH_WORDS)) + 1)
        for pick in batches:
            if not len(pick):
                continue
            own, local = np.unique(codes[ranges(ptr[pick], size[pick])], return_inverse=True)
            flat, word = ids[ranges(at[own], count[own])], np.repeat(np.arange(len(own)), count[own])
            begin = np.concatenate(([0], np.cumsum(size[pick])))
            mean, expected = forward_backward(field.potentials(flat, word, len(own))[local], begin, field.moves, pairs=True)
            truth = np.repeat(label[pick], size[pick])
            fair = (share.sum() / len(names) / np.maximum(share, 1))[truth]  # languages weigh alike
            wrong = -mean
            wrong[np.arange(len(truth)), truth] += 1
            wrong *= fair[:, None] / len(truth)
            by_word = np.stack([np.bincount(local, weights=w, minlength=len(own)) for w in wrong.T], axis=1)
            grad = np.stack([np.bincount(flat, weights=w[word], minlength=BUCKETS) for w in by_word.T], axis=1)
            used = np.bincount(flat, minlength=BUCKETS) > 0
            slow += (grad**2).sum(axis=1)
            field.weights += np.where(used[:, None], RATE * grad / np.sqrt(slow)[:, None] - 1e-3 * field.weights, 0.0)
            real = np.diag(np.bincount(label[pick], weights=size[pick] - 1, minlength=len(names)))
            grad_moves = (real - expected) / len(truth) - 0.05 * (field.moves - np.eye(len(names)))
            slow_moves += grad_moves**2
            field.moves += RATE * grad_moves / np.sqrt(slow_moves)
    return field


def train(documents: DataFrame) -> Field | None:
    """Fit a field in one task on a bounded sample of the rows that may be learnt from; None without such rows."""
    return fitted(sample(documents, "lang", TRAIN_ROWS), _fit)


def identify(documents: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred, score, and the expected share of each learnt language's words."""
    bound_batches(documents.sparkSession)
    given = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = given.value
        known = field.words() if field else None
        for batch, words in word_slices(batches):
            texts = batch.num_rows
            pred, score, shares = [UNKNOWN] * texts, np.zeros(texts), [""] * texts
            if known is not None:
                codes, rows = known.of(words)
                codes, ptr = _worded(codes, rows.any(axis=1), words.ptr)
                mean, _ = forward_backward(rows[codes], ptr, field.moves)
                size = np.diff(ptr)
                full = np.flatnonzero(size)
                if len(full):
                    share = np.add.reduceat(mean, ptr[full], axis=0) / size[full, None]
                    best = share.argmax(axis=1)
                    score[full] = np.clip(share[np.arange(len(full)), best], 0, 1)
                    for i, k, row in zip(full.tolist(), best.tolist(), share.tolist(), strict=True):
                        pred[i] = field.names[k]
                        shares[i] = ",".join(f"{n}:{x:.3f}" for n, x in zip(field.names, row, strict=True) if x >= 0.0005)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(shares, pa.string())], names=["doc_id", "lang_pred", "score", "shares"]
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, shares string")


def languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares."""
    return identify(documents, train(documents)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "shares")
