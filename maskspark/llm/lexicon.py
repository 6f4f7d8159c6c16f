"""Ids of texts by way of their distinct words: Arrow splits and numbers the words of a batch, each
distinct word is encoded once, and numpy puts the texts' ids together."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Memory:
    """A dictionary of two generations: when the young one is full it becomes the old one, and what is used again moves up."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def find(self, keys: list[str], learn: Callable[[list[str]], Iterable[object]]) -> list[object]:
        """The values of keys; learn(missing) gives those of unknown ones."""
        found = list(map(self.young.get, keys))
        lost = [i for i, x in enumerate(found) if x is None]
        if not lost:
            return found
        if len(self.young) + len(lost) > self.size:
            self.old, self.young = self.young, {}
        old, young, unknown = self.old, self.young, []
        for i in lost:
            if (x := old.get(keys[i])) is None:
                unknown.append(i)
            else:
                found[i] = young[keys[i]] = x
        if unknown:
            words = [keys[i] for i in unknown]
            for i, word, value in zip(unknown, words, learn(words), strict=True):
                found[i] = young[word] = value
        return found


def numbered(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of all words between single blanks, the distinct words, and where each text's codes begin (and end)."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten().dictionary_encode()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def put_together(codes: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the coded words in order, and before each code the count of ids so far (one entry more than codes)."""
    length = np.array([len(x) for x in ids], np.int64) >> 2
    flat = np.frombuffer(b"".join(ids), np.int32)
    begin = np.cumsum(length) - length
    size = length[codes]
    before = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(begin[codes] - before[:-1], size) + np.arange(before[-1])
    return flat[place], before
