"""Byte-level BPE over a corpus, in numpy matrices.

Texts are split into words by the tokenizer's pattern; every word new to a
worker is encoded once. New words are padded into matrices by length bucket.
In each round every row merges its leftmost pair of least rank, and with it the
further places of that pair that don't overlap: what a merge makes ranks behind
it, so one at a time would give the same. Pair ranks come from an
open-addressing hash table, the merged cells are written, the cells to their
right are cut out of the rows (where all rows lose one cell, by a masked
reshape), and only the pairs beside the merges are looked up again. Rows without
a mergeable pair leave the matrix.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType

from caseloom.llm.spread import spread

#: Where the vocabulary of byte_bpe_50k lies; a parameter of every function that encodes.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that byte-level BPE of this vocabulary splits words by.
WORDS = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
)
#: Characters encoded at a time.
BLOCK_CHARS = 2_000_000
#: Words a worker remembers; beyond it, it starts anew.
KNOWN_WORDS = 300_000
_NO_RANK = np.int32(2**31 - 1)


def byte_alphabet() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """Rank of a pair of ids, by open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        bits = max(int(2 * len(left)).bit_length(), 4)  # at most half full
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NO_RANK, np.int32)
        keys = left.astype(np.int64) << 32 | right
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] == -1
            slots, first = np.unique(at[free], return_index=True)
            put = todo[free][first]
            self.keys[slots], self.ranks[slots] = keys[put], put
            rest = self.keys[at] != keys[todo]
            todo, at = todo[rest], (at[rest] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a negative id has no rank."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(keys), _NO_RANK, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            go = ~hit & (found != -1)
            todo, at = todo[go], (at[go] + 1) & self.last
        return out.reshape(left.shape)


class Encoder:
    """One vocabulary and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int32)
        self.pairs = PairTable(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, length of each text's part); null and empty texts have no ids."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        known, codes, counts, fresh = self.known, [], [], []
        for text in texts:
            words = WORDS.findall(text) if text else []
            for w in words:
                c = known.get(w)
                if c is None:
                    c = known[w] = len(known)
                    fresh.append(w)
                codes.append(c)
            counts.append(len(words))
        if fresh:
            ids, sizes = self._encode_words([w.encode("utf-8", "surrogatepass") for w in fresh])
            self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(sizes) - sizes))
            self.size = np.concatenate((self.size, sizes))
            self.pool = np.concatenate((self.pool, ids))
        code = np.array(codes, np.int64)
        size = self.size[code]
        ends = np.cumsum(size)
        flat = self.pool[np.repeat(self.begin[code] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate(([0], ends))[np.cumsum([0, *counts])]
        return flat, np.diff(upto)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        raw = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        begin = np.cumsum(lengths) - lengths
        out_ids: list[np.ndarray | None] = [None] * len(words)
        bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for b in np.unique(bucket):
            rows = np.flatnonzero(bucket == b)
            width = int(lengths[rows].max())
            step = max(1, 4_000_000 // width)
            for part in range(0, len(rows), step):
                at = rows[part : part + step]
                cols = np.arange(width)
                inside = cols < lengths[at, None]
                cells = np.where(inside, raw[np.minimum(begin[at, None] + cols, len(raw) - 1)], -1)
                for r, ids in self._merge(at, cells):
                    out_ids[r] = ids
        return np.concatenate(out_ids), np.array([len(x) for x in out_ids], np.int64)

    def _merge(self, rows: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        ranks = self.pairs.rank(cells[:, :-1], cells[:, 1:])
        while True:
            least = ranks.min(1) if cells.shape[1] > 1 else np.full(len(rows), _NO_RANK)
            done = least == _NO_RANK
            if done.any():
                for r, line in zip(rows[done].tolist(), cells[done], strict=True):
                    yield r, line[line >= 0]
                if done.all():
                    return
                rows, cells, ranks, least = rows[~done], cells[~done], ranks[~done], least[~done]
            n, width = cells.shape
            hit = ranks == least[:, None]
            line, at = np.nonzero(hit)
            if len(at) > n:  # of hits side by side, which overlap, every other one
                begins = hit & ~np.concatenate((np.zeros((n, 1), bool), hit[:, :-1]), 1)
                since = np.arange(width - 1) - np.maximum.accumulate(np.where(begins, np.arange(width - 1), 0), 1)
                line, at = np.nonzero(hit & (since % 2 == 0))
            cells[line, at] = self.merged[least[line]]
            keep = np.ones((n, width), bool)
            keep[line, at + 1] = False
            pair_keep = np.ones((n, width - 1), bool)
            pair_keep[line, at] = False
            if len(at) == n:  # one merge a row: all lose one cell
                cells, ranks = cells[keep].reshape(n, width - 1), ranks[pair_keep].reshape(n, width - 2)
            else:
                lost = np.bincount(line, minlength=n)
                at = at - (np.arange(len(at)) - (np.cumsum(lost) - lost)[line])
                cells, ranks = _left(cells, keep, width - lost.min(), -1), _left(ranks, pair_keep, width - lost.min() - 1, _NO_RANK)
            width = cells.shape[1]
            for pair in (at - 1, at):
                ok = np.flatnonzero((pair >= 0) & (pair < width - 1))
                ranks[line[ok], pair[ok]] = self.pairs.rank(cells[line[ok], pair[ok]], cells[line[ok], pair[ok] + 1])


def _left(table: np.ndarray, keep: np.ndarray, width: int, blank: int) -> np.ndarray:
    """What is kept of each row, moved to the left."""
    out = np.full((len(table), width), blank, table.dtype)
    to = np.cumsum(keep, 1) - 1
    inside = keep & (to < width)
    row, _ = np.nonzero(inside)
    out[row, to[inside]] = table[inside]
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def blocks(texts: list[str | None]) -> Iterator[slice]:
    """Slices of texts of about BLOCK_CHARS; a longer text makes one of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= BLOCK_CHARS:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def token_ids(documents: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids ARRAY<INT>), one row per input row.

    Null, and empty, texts have the empty list; blank ones have the ids of
    their white space. No special tokens; what spells one is ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for part in blocks(texts):
                flat, sizes = enc.encode(texts[part])
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(part.start, part.stop - part.start), ids], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """documents with n_tokens BIGINT in place of text; other columns stay."""
    kept = [c for c in documents.columns if c != "text"]
    schema = documents.select(*kept).schema.add("n_tokens", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            sizes = [enc.encode(texts[part])[1] for part in blocks(texts)]
            n = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), n], [*kept, "n_tokens"])

    return spread(documents.select(*kept, "text"), "doc_id").mapInArrow(run, schema)
