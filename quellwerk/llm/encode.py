"""Token ids of whole corpora by a public byte-level BPE tokenizer (problem 7).

Words (the tokenizer's own pre-tokens) are encoded once per process and batch:
words not met before are bucketed by length into padded numpy matrices, and in
every round each row merges its leftmost pair of minimum rank.  Pair ranks come
from an open-addressing hash table held in numpy arrays; rows without a pair
left are compacted away.  Documents are then gathered from the word table.

Defined results: null and empty texts have an empty list; special tokens are
ordinary text; lone surrogates, which UTF-8 cannot hold, count as U+FFFD.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pre-token pattern of byte_bpe_50k.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = np.int32(2**31 - 1)
#: Words longer than this many bytes are merged with a heap instead of a matrix row.
LONGEST_ROW = 256
#: Words kept per process before the word table starts anew.
MOST_WORDS = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class PairTable:
    """(left id, right id) -> (rank, merged id) by hashing with linear probing, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.rank = np.full(self.mask + 1, NO_PAIR, np.int32)
        self.merged = np.zeros(self.mask + 1, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = keys[todo[put]], todo[put], merged[todo[put]]
            todo, slot = todo[~put], (slot[~put] + (~free[~put])) & self.mask
        self.pairs = dict(zip(keys.tolist(), zip(range(len(keys)), merged.tolist())))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 where it has none."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, slot, -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Encoder:
    """Encodes documents; holds the vocabulary and the table of words met so far."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = PairTable(*(np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges))))
        self.split = regex.compile(PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        n = len(words)
        ids = np.full((n, width + 1), -1, np.int32)
        lengths = np.fromiter(map(len, words), np.int64, n)
        ids[np.arange(width + 1) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        out: list = [None] * n
        rows = np.arange(n)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(1)
            line = np.arange(len(rows))
            live = rank[line, at] != NO_PAIR
            if not live.all():
                for r in np.flatnonzero(~live):
                    out[rows[r]] = ids[r, : lengths[r]].copy()
                rows, ids, rank, lengths, at = rows[live], ids[live], rank[live], lengths[live], at[live]
                if not len(rows):
                    break
                width = int(lengths.max())
                ids, rank = ids[:, : width + 1], rank[:, :width]
                line = np.arange(len(rows))
            slot = self.table.find(ids[line, at], ids[line, at + 1])
            after = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[line, at] = self.table.merged[slot]
            lengths = lengths - 1
            rank[:, :-1] = np.where(after[:, : rank.shape[1] - 1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NO_PAIR
            rank[line, at] = self._ranks(ids[line, at], ids[line, at + 1])
            back = at > 0
            rank[line[back], at[back] - 1] = self._ranks(ids[line[back], at[back] - 1], ids[line[back], at[back]])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        real = (left >= 0) & (right >= 0)
        out = np.full(left.shape, NO_PAIR, np.int32)
        slot = self.table.find(left[real], right[real])
        out[real] = np.where(slot >= 0, self.table.rank[slot], NO_PAIR)
        return out

    def _heap(self, word: bytes) -> np.ndarray:
        """The same merges for one very long word, with a linked list and a heap."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(ids), self.table.pairs
        following, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(pairs[k][0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = following[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a << 32 | b][1], -1
            following[i] = following[j]
            if following[i] >= 0:
                before[following[i]] = i
            for left, right in ((before[i], i), (i, following[i])):
                if left >= 0 and right >= 0 and (k := ids[left] << 32 | ids[right]) in pairs:
                    heapq.heappush(heap, (pairs[k][0], left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _learn(self, words: list[str]) -> None:
        """Encode words that are not in the table yet."""
        raw = [w.encode("utf-8", "replace") if not w.isascii() else w.encode() for w in words]
        done: list = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            buckets.setdefault((len(b) + 3) // 4 * 4 if len(b) <= 32 else 1 << (len(b) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            if width > LONGEST_ROW:
                for i in rows:
                    done[i] = self._heap(raw[i])
                continue
            step = max(1, 4_000_000 // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._matrix([raw[i] for i in part], width)):
                    done[i] = ids
        sizes = np.fromiter(map(len, done), np.int64, len(done))
        total, base, n = int(sizes.sum()), len(self.index), len(done)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + n > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : self.used + total] = np.concatenate(done) if n else 0
        self.starts[base : base + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[base : base + n] = sizes
        self.used += total
        self.index.update(zip(words, range(base, base + n)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the offsets of each text."""
        if len(self.index) > MOST_WORDS:
            self._clear()
        words: list[str] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                w = self.split(t)
                counts[i + 1] = len(w)
                words += w
        known = self.index
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            self._learn(new)
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.arange(total) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        offsets = np.concatenate([[0], ends])[np.cumsum(counts)]
        return self.flat[gather], offsets


_encoders: dict[str, Encoder] = {}


def encoder(path: str = TOKENIZER) -> Encoder:
    """The process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, ids: str = "ids") -> DataFrame:
    """key and ids (array<int>) of every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            flat, offsets = enc.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, ids])

    source = docs.selectExpr(f"cast(`{key}` as bigint) as `{key}`", f"`{text}` as t")
    return source.mapInArrow(run, f"`{key}` bigint, `{ids}` array<int>")
