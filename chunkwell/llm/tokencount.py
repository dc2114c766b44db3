"""Token counts: each distinct pre-token is counted once, and documents sum the counts of theirs.

A tokenizer cuts a text into pre-tokens and encodes each on its own, so a text's tokens are the sum, over its
distinct pre-tokens, of its frequency times the pre-token's tokens.  No ids are made but those of distinct
pre-tokens, and only their number is kept.

1. Tasks cut texts and send on their distinct pre-tokens with frequencies; Spark sums them, and each
   distinct one is counted once.  The table of (piece, tokens, freq) is written.
2. The at most HOT most frequent ones, found by a limit on the frequency, go to all tasks: of a natural
   corpus they are nearly all occurrences.  Tasks cut the texts again, sum what they can, and give the
   document's other pre-tokens with their frequencies.
3. Those are joined with the table by the pre-token itself.  None of them is more frequent than the
   HOTth, so no key of the join is hot.  Sums by document are partial before they are shuffled.

Pre-tokens, by the kind of file: `.json`, the library's normalizer and pre-tokenizer, or, for byte-level
pre-tokenizers, the same cuts made on arrays of bytes (characters beyond ASCII are classed by asking the
library once for each distinct one); added tokens in a text are cut out first and are a token each.
`.model`, the normalized text before each mark of a blank.  Where a file's rules don't allow such cuts
(tokens that join words, added tokens with other rules), the whole text is one pre-token.

Defined results: null or empty text has no bytes and no tokens; repeated rows keep a row each; a null id is
kept; other columns are ignored; a very long text is a slice of its own.  Within a slice pre-tokens are told
apart by 64-bit hashes of their bytes, between tasks by themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm._shared import bound_batches, materialise, ranges, slices, span_hashes, string_parts

HOT = 1 << 16
#: Characters of texts that are cut at a time.
SLICE_BYTES = 4 << 20
LETTER, NUMBER, OTHER, BLANK, UNKNOWN = range(5)
#: What an apostrophe joins in the byte-level rule.
SUFFIXES = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
SPACE_MARK = "▁"


class Cuts:
    """Distinct pre-tokens of an array of texts: pieces, and by (text, piece) the frequency; tokens that need no piece."""

    def __init__(self, pieces: pa.Array, text: np.ndarray, piece: np.ndarray, count: np.ndarray, extra: np.ndarray) -> None:
        self.pieces, self.text, self.piece, self.count, self.extra = pieces, text, piece, count, extra


def _by_text(groups: list[Counter], extra: np.ndarray) -> Cuts:
    flat = [(k, piece, n) for k, group in enumerate(groups) for piece, n in group.items()]
    codes, pieces = pd.factorize(np.array([x[1] for x in flat], dtype=object))
    return Cuts(pa.array(pieces.tolist(), pa.large_string()), np.array([x[0] for x in flat], np.int64), codes.astype(np.int64), np.array([x[2] for x in flat], np.int64), extra)


class PreTokens:
    """Cuts texts as a tokenizer file of the tokenizers library (.json) does, and counts the tokens of a pre-token."""

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        added = [t for t in rules["added_tokens"] if t["content"]]
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.plain_added = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        pre = rules["pre_tokenizer"] or {}
        self.whole = rules["pre_tokenizer"] is None  # no cuts: a text is its own pre-token
        self.bytes = rules["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        self.kinds = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self._probe(np.arange(128))

    # -------------------------------------------------------- kinds of characters

    def _probe(self, codes: np.ndarray) -> None:
        """Class characters by what the library joins them with: a letter, a digit, a mark, or nothing."""
        if not self.bytes:
            return
        for code in codes.tolist():
            c = chr(code)
            joins = [len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x + c)) == 1 for x in ("a", "1", "!")]
            self.kinds[code] = joins.index(True) if any(joins) else BLANK

    def _characters(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte places of characters, and their kinds."""
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        lead = raw[place]
        code = lead.astype(np.int32)
        for low, high, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
            wide = np.flatnonzero((lead >= low) & (lead < high))
            value = (lead[wide] & bits).astype(np.int32)
            for k in range(1, more + 1):
                value = value << 6 | (raw[place[wide] + k] & 0x3F)
            code[wide] = value
        kind = self.kinds[code]
        if (new := np.unique(code[kind == UNKNOWN])).size:
            self._probe(new)
            kind = self.kinds[code]
        return place, kind

    # -------------------------------------------------------- cuts

    def _starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte places where pre-tokens start, by the byte-level rule: contractions, runs of one kind with a space before, and blanks."""
        place, kind = self._characters(raw)
        n = len(place)
        byte = raw[place]
        first = np.zeros(n + 1, dtype=bool)  # the first character of a text
        first[np.searchsorted(place, offsets)] = True
        before, after = np.full(n, UNKNOWN, dtype=np.uint8), np.full(n, UNKNOWN, dtype=np.uint8)
        before[1:] = kind[:-1]
        before[first[:-1]] = UNKNOWN
        after[:-1] = kind[1:]
        after[first[1:]] = UNKNOWN
        spaced = np.zeros(n, dtype=bool)  # a space stands before it, in its text
        spaced[1:] = byte[:-1] == 0x20
        spaced[first[:-1]] = False
        blank = kind == BLANK
        start = (before != kind) & ~spaced
        # of blanks before something else the last one stands alone, or with what follows if it is a space
        start |= blank & (before != BLANK)
        start |= blank & (before == BLANK) & (after != BLANK) & (after != UNKNOWN)
        start[spaced & blank & (before == BLANK) & ((after == BLANK) | (after == UNKNOWN))] = False
        start[first[:-1]] = True
        # an apostrophe on its own takes the suffix after it
        mark = np.flatnonzero((byte == 0x27) & (before != OTHER) & ~spaced & (after == LETTER))
        if mark.size:
            padded = np.concatenate([raw, np.zeros(3, np.uint8)])
            at = place[mark]
            for suffix in SUFFIXES:
                fits = np.ones(len(mark), dtype=bool)
                for k, c in enumerate(suffix, 1):
                    fits &= padded[at + k] == c
                    fits &= ~first[mark + k]
                hit = mark[fits]
                start[hit + 1] = False
                rest = hit + 1 + len(suffix)
                rest = rest[rest < n]
                start[rest[(kind[rest] == LETTER) & ~first[rest]]] = True
        return place[start]

    def _segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts without added tokens, the text each comes from, and the added tokens of each text."""
        n = len(texts)
        extra, owner = np.zeros(n, np.int64), np.arange(n)
        if self.added is None:
            return texts, owner, extra
        odd = pc.match_substring_regex(texts, self.added.pattern)
        which = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not which.size:
            return texts, owner, extra
        more, owners = [], []
        for i in which.tolist():
            parts = self.added.split(texts[i].as_py())
            extra[i] = len(parts) - 1
            more += parts
            owners += [i] * len(parts)
        plain = pc.if_else(odd, "", texts)
        return pa.concat_arrays([plain, pa.array(more, pa.large_string())]), np.concatenate([owner, owners]), extra

    def cut(self, texts: pa.Array) -> Cuts:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if self.whole or not self.plain_added:
            return _by_text([Counter([t]) if t else Counter() for t in texts.to_pylist()], np.zeros(n, np.int64))
        parts, owner, extra = self._segments(texts)
        if not self.bytes:
            groups = [Counter() for _ in range(n)]
            normal, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
            for k, text in zip(owner.tolist(), parts.to_pylist(), strict=True):
                if text:
                    groups[k].update(piece for piece, _ in pre.pre_tokenize_str(normal.normalize_str(text) if normal else text))
            return _by_text(groups, extra)
        raw, offsets = string_parts(parts)
        if not len(raw):
            return _by_text([Counter() for _ in range(n)], extra)
        start = self._starts(raw, offsets)
        end = np.append(start[1:], len(raw))
        codes, distinct = pd.factorize(span_hashes(raw, start, end))
        one = np.zeros(len(distinct), dtype=np.int64)
        one[codes[::-1]] = np.arange(len(codes))[::-1]
        size = end[one] - start[one]
        data = raw[ranges(start[one], size)]
        pieces = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data))
        text = owner[np.searchsorted(offsets, start, side="right") - 1]
        pairs, count = np.unique(text * len(distinct) + codes, return_counts=True)
        return Cuts(pieces, pairs // len(distinct), pairs % len(distinct), count, extra)

    def tokens(self, piece: str) -> int:
        """Tokens of a pre-token."""
        if self.whole or not self.plain_added:
            return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)] if self.bytes else [piece]
        return sum(len(self.tokenizer.model.tokenize(p)) for p in pieces)


class MarkedPieces:
    """Cuts texts of a sentencepiece file (.model) before each mark of a blank, and counts the tokens of a pre-token."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        # tokens across words, or runs of unknown characters as one, would make sums differ
        bytes_too = any(self.model.is_byte(k) for k in range(len(vocabulary)))
        self.apart = bytes_too and not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in vocabulary)
        self.word = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+")

    def cut(self, texts: pa.Array) -> Cuts:
        texts = pc.fill_null(texts, "").to_pylist()
        if self.apart:
            groups = [Counter(self.word.findall(self.model.normalize(t))) for t in texts]
        else:
            groups = [Counter([t]) if t else Counter() for t in texts]
        return _by_text(groups, np.zeros(len(texts), np.int64))

    def tokens(self, piece: str) -> int:
        if self.apart and piece == SPACE_MARK:
            return 1 if self.model.piece_to_id(piece) != self.model.unk_id() else len(piece.encode())
        if self.apart and piece.startswith(SPACE_MARK):  # the library puts the first mark back
            piece = piece[1:].replace(SPACE_MARK, " ")
        return len(self.model.encode(piece, add_bos=False, add_eos=False))


_CUTTERS: dict[str, PreTokens | MarkedPieces] = {}


def cutter(path: str) -> PreTokens | MarkedPieces:
    """A worker's cutter of a tokenizer file."""
    if path not in _CUTTERS:
        _CUTTERS[path] = MarkedPieces(path) if path.endswith(".model") else PreTokens(path)
    return _CUTTERS[path]


def counted_pieces(documents: DataFrame, tokenizer: str) -> DataFrame:
    """The distinct pre-tokens of all texts: piece, tokens, freq."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                cuts = cutter(tokenizer).cut(batch.column("text"))
                freq = np.bincount(cuts.piece, weights=cuts.count, minlength=len(cuts.pieces)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([cuts.pieces.cast(pa.string()), pa.array(freq)], names=["piece", "freq"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [cutter(tokenizer).tokens(p) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(tokens, pa.int64()), batch.column("freq")], names=["piece", "tokens", "freq"])

    found = documents.select("text").mapInArrow(distinct, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return found.mapInArrow(counted, "piece string, tokens long, freq long")


def hot_limit(pieces: DataFrame, most: int) -> int:
    """A frequency that at most `most` pieces have or pass, the least but for the width of a class: frequencies are counted in 16 classes an octave."""
    by = pieces.groupBy(F.floor(16 * F.log2("freq")).alias("class")).agg(F.count("*").alias("n"), F.min("freq").alias("least")).collect()  # 1,024 rows at most
    total, limit = 0, np.iinfo(np.int64).max
    for r in sorted(by, reverse=True):
        total += r["n"]
        if total > most:
            break
        limit = r["least"]
    return int(limit)


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 512, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of documents (doc_id, text)."""
    spark = documents.sparkSession
    bound_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = materialise(counted_pieces(rows, tokenizer), "pieces")
    least = hot_limit(pieces, hot)
    table = pieces.where(F.col("freq") >= least).select("piece", "tokens").toArrow()  # `hot` rows at most
    known = spark.sparkContext.broadcast((table.column("piece").combine_chunks().cast(pa.large_string()), table.column("tokens").to_numpy()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tokens = known.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                cuts = cutter(tokenizer).cut(batch.column("text"))
                row = pc.fill_null(pc.index_in(cuts.pieces, names), -1).to_numpy(zero_copy_only=False)[cuts.piece] if len(names) else np.full(len(cuts.piece), -1)
                there, n = row >= 0, batch.num_rows
                sums = cuts.extra + np.bincount(cuts.text[there], weights=cuts.count[there] * tokens[row[there]], minlength=n).astype(np.int64)
                text, piece = cuts.text[~there], cuts.piece[~there]
                at = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
                rest = pa.StructArray.from_arrays([cuts.pieces.take(pa.array(piece)).cast(pa.string()), pa.array(cuts.count[~there])], names=["piece", "n"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("h"), batch.column("n_bytes"), pa.array(sums), pa.ListArray.from_arrays(at, rest)],
                    names=["doc_id", "h", "n_bytes", "tokens", "rest"],
                )

    keyed = rows.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    docs = materialise(keyed.mapInArrow(summed, "doc_id long, h long, n_bytes long, tokens long, rest array<struct<piece: string, n: long>>"), "documents")
    cold = docs.select("doc_id", "h", F.explode("rest").alias("r")).select("doc_id", "h", "r.piece", "r.n")
    joined = cold.join(pieces.where(F.col("freq") < least).select("piece", "tokens"), "piece")
    more = joined.groupBy("doc_id", "h").agg(F.sum(F.col("n") * F.col("tokens")).alias("tokens"))
    own = docs.select("doc_id", "h", F.lit(1).alias("rows"), "n_bytes", "tokens")
    # equal rows share their sums, which are dealt out again
    both = own.unionByName(more.select("doc_id", "h", F.lit(0).alias("rows"), F.lit(0).cast("long").alias("n_bytes"), "tokens"))
    sums = both.groupBy("doc_id", "h").agg(F.sum("rows").alias("rows"), F.sum("n_bytes").alias("n_bytes"), F.sum("tokens").alias("tokens"))
    each = sums.select("doc_id", F.expr("n_bytes div rows").alias("n_bytes"), F.expr("tokens div rows").alias("n_tokens"), F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("_one"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
