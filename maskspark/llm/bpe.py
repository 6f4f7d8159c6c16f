"""Byte-level BPE encoding and decoding.

Texts are cut at single blanks (which the pattern never crosses) and by the pattern; every
distinct piece of a batch becomes a row of a padded matrix of its length bucket. In each round
every row merges its leftmost pair of least rank, found in a hashed pair table, and is compacted;
rows without a pair are finished. Pieces longer than the widest bucket go through the same merges
one by one with a heap, so that time stays near linear.

Edge cases. Null and empty texts: no ids. Whole texts are encoded; very long ones in blocks of
pieces. Special tokens have no meaning: their strings are ordinary text. Repeated rows each give
a row; null doc_id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from maskspark.llm.common import map_pieces, per_worker, texts
from maskspark.llm.lexicon import Memory, numbered, put_together

#: Widest row of a matrix, in bytes.
WIDEST = 512
#: Distinct chunks in each of the two generations that a worker remembers; a full one becomes the old one.
REMEMBERED = 300_000
#: Characters of one text handled at once; blocks end at single blanks, where nothing is joined.
BLOCK = 1 << 20
#: Cells of one matrix.
CELLS = 1 << 20

_NONE = np.int32(2**31 - 1)
_RUN = regex.compile(r"\s\s")
#: The character before a blank that stands alone.
_BLANK = regex.compile(r"\S(?=\x20\S)")


class PairTable:
    """Open-addressed hash table from a pair of ids to the id of their merge."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        slots, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            at = slots[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several, the last one written stays
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.keys[slots] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & self.mask
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


class Codec:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        by_id = {i: t for t, i in self.ranks.items()}
        size = max(by_id) + 1
        self.length = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        if size >= 1 << 20:
            raise ValueError("a pair of ids must fit the key of the pair table")
        self.pair_of = dict(zip(keys, values, strict=True))
        self.shown = [str(i) for i in range(size)]
        self.memory = Memory(REMEMBERED)

    def merge(self, rows: list[bytes]) -> list[list[int]]:
        """The ids of each row, by length-bucketed matrices."""
        out: list[list[int]] = [None] * len(rows)
        buckets: dict[int, list[int]] = {}
        for i, row in enumerate(rows):
            n = len(row)
            if n > WIDEST:
                out[i] = self._merge_long(row)
            else:
                buckets.setdefault(n if n <= 16 else -(-n // 8) * 8 if n <= 64 else 1 << (n - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                self._merge_bucket(rows, members[at : at + step], width, out)
        return out

    def _merge_bucket(self, rows: list[bytes], members: list[int], width: int, out: list) -> None:
        sizes = np.array([len(rows[i]) for i in members])
        ids = np.zeros((len(members), width), np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows[i] for i in members), np.uint8)]
        ranks = np.full((len(members), width), _NONE, np.int32)  # of each pair, by its left place
        if width > 1:
            r, c = np.nonzero(np.arange(1, width) < sizes[:, None])
            ranks[r, c] = self.pairs.get(ids[r, c], ids[r, c + 1])
        owner = np.array(members)
        while len(owner):
            row = np.arange(len(owner))
            best = ranks.argmin(1)  # the leftmost least
            rank = ranks[row, best]
            done = rank == _NONE
            if done.any():
                for k, n, found in zip(owner[done].tolist(), sizes[done].tolist(), ids[done].tolist(), strict=True):
                    out[k] = found[:n]
                left = ~done
                ids, ranks, sizes, owner, best, rank = ids[left], ranks[left], sizes[left], owner[left], best[left], rank[left]
                row = np.arange(len(owner))
                if not len(owner):
                    return
            width = int(sizes.max())
            ids, ranks = ids[:, :width], ranks[:, :width]
            ids[row, best] = rank
            after = np.arange(width - 1) > best[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks = np.where(after, ranks[:, 1:], ranks[:, :-1])
            sizes = sizes - 1
            right = best < sizes - 1
            ranks[row, best] = _NONE
            ranks[row[right], best[right]] = self.pairs.get(ids[row[right], best[right]], ids[row[right], best[right] + 1])
            first = best > 0
            ranks[row[first], best[first] - 1] = self.pairs.get(ids[row[first], best[first] - 1], ids[row[first], best[first]])

    def _merge_long(self, row: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(row, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get = self.pair_of.get
        heap = [(rank, i) for i in range(n - 1) if (rank := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (new := get(ids[a] << 20 | ids[after[a]])) is not None:
                    heapq.heappush(heap, (new, a))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def _learn(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Ids of chunks and their decimal form; the pieces that no chunk shares are merged together."""
        pieces = [self.pattern.findall(x) for x in chunks]
        fresh = list({p for found in pieces for p in found})
        raw = [p.encode() for p in fresh]
        ids = [None if (w := self.ranks.get(b)) is None else [w] for b in raw]
        todo = [i for i, w in enumerate(ids) if w is None]
        for i, found in zip(todo, self.merge([raw[i] for i in todo]), strict=True):
            ids[i] = found
        of, shown, out = dict(zip(fresh, ids, strict=True)), self.shown, []
        for found in pieces:
            all_ = of[found[0]] if len(found) == 1 else [i for p in found for i in of[p]]
            out.append((array("i", all_).tobytes(), ",".join([shown[i] for i in all_])))
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids and their decimal form for each text. A single blank between two characters that
        are no white space begins a piece, so texts of such blanks only are cut there; the others
        are cut by the pattern itself."""
        whole = [bool(t) and not (_RUN.search(t) or t[0].isspace() or t[-1].isspace()) for t in texts]
        codes, words, ends = numbered(pa.array([t for t, w in zip(texts, whole, strict=True) if w], pa.string()))
        keys, extra = [f" {w}" for w in words], {}

        def code(key: str) -> int:
            return extra.setdefault(key, len(words) + len(extra))

        codes[ends[:-1]] = [code(words[c]) for c in codes[ends[:-1]]]  # nothing stands before a text's first word
        parts, k = [], 0
        for text, w in zip(texts, whole, strict=True):
            if w:
                parts.append(codes[ends[k] : ends[k + 1]])
                k += 1
            else:
                parts.append(np.array([code(p) for p in self.pattern.findall(text)], np.int64))
        held = self.memory.find([*keys, *extra], self._learn)
        all_ = np.concatenate([np.empty(0, np.int64), *parts])
        ids, before = put_together(all_, [x[0] for x in held])
        shown, out, at = [x[1] for x in held], [], 0
        for part in parts:
            out.append((ids[before[at] : before[at + len(part)]], ",".join([shown[c] for c in part.tolist()])))
            at += len(part)
        return out

    def blocks(self, text: str) -> Iterator[str]:
        """A long text in parts that end before a single blank inside it."""
        at = 0
        while len(text) - at > BLOCK:
            m = _BLANK.search(text, at + BLOCK)
            if not m:
                break
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int32), *(x[0] for b in self.blocks(text) for x in self.encode_batch([b]))])

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            size = self.length[part]
            place = np.repeat(self.begin[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out.append(self.flat[place].tobytes())
        return b"".join(out)


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs."""

    def make():
        codec = per_worker(("bpe", path, pattern), lambda: Codec(path, pattern))

        def step(piece: pa.RecordBatch) -> dict:
            out = {"doc_id": piece["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            all_ = texts(piece)
            short = iter(codec.encode_batch([t for t in all_ if len(t) <= BLOCK]))
            for text in all_:
                ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                for ids, shown in [next(short)] if len(text) <= BLOCK else (x for b in codec.blocks(text) for x in codec.encode_batch([b])):
                    if len(ids):
                        ids_hash.update((("," if n else "") + shown).encode())
                        text_hash.update(codec.decode(ids))
                        n += len(ids)
                out["n_tokens"].append(n)
                out["ids_sha256"].append(ids_hash.hexdigest())
                out["decoded_sha256"].append(text_hash.hexdigest())
            return out

        return step

    return map_pieces(docs.select("doc_id", "text"), "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) for every row of docs."""

    def make():
        codec = per_worker(("bpe", path, pattern), lambda: Codec(path, pattern))
        return lambda piece: {"doc_id": piece["doc_id"], "ids": [codec.encode(t).tolist() for t in texts(piece)]}

    return map_pieces(docs.select("doc_id", "text"), "text", "doc_id long, ids array<int>", make)
