"""N-gram Jaccard join: size-aware heavy-light set-similarity join over word shingles.

Each distinct shingle set is one class (copies share it). Sets up to a boundary size are *light*:
every 2-subset of their prefix is a key. Larger ones are *heavy*: each prefix shingle is a key
whose inverted list is scanned. The boundary minimises the keys made plus the list entries
scanned, from the histogram of sizes and the lengths of the lists that sets of each size meet,
as the first pass measures them. Prefixes follow one global order (rare shingles first);
position bounds drop a list entry that cannot reach the threshold. Within a list, neighbours in
a random order are compared first; what they link is one component. Only pairs across components
are then joined, near their first common key, and only those whose parity sketches (a bound on
the symmetric difference) leave the threshold in reach. Nothing is dropped that could link, so
components are exact. Lists known to be long are dealt over several tasks for the neighbours;
comparisons are dealt in blocks of bounded bytes.

Edge cases. Null text, empty text and text of white space only: empty set, linked with nothing,
its own component. Fewer words than a shingle: one shingle of all words. Repeated rows and equal
sets: one class. Null doc_id: kept as a row; its component is the smallest id it reaches, else
null. Extra columns are ignored. An empty table gives an empty result. Shingles are compared by
64-bit hashes, so a false match needs a collision inside one pair; classes are told apart by 128
bits (a second hash takes the place of the first where two sets share the first).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskspark.llm.common import map_pieces, materialize, release, share

#: Shingles that get a rank in the global order by frequency; the others come first, by hash. A bound on broadcast data (4 MB), not on what is compared.
RANKED_SHINGLES = 1 << 18
#: Shingles counted at once in a task before repeated ones are handed on.
COUNT_BLOCK = 1 << 21
#: Largest boundary between light and heavy sets that is considered: above it a set has more than 31,000 2-subsets.
LARGEST_LIGHT = 1000
#: Neighbours compared with each entry of an inverted list in the first round.
NEIGHBOURS = 4
#: Entries of an inverted list beyond which its neighbours are looked for in several parts.
LONG_LIST = 1 << 16
#: Bytes of sets that one block of comparisons names (a set counts for each of its pairs).
BLOCK_BYTES = 8 << 20
#: Edges that one task contracts at most (some 50 MB of Python objects).
TASK_EDGES = 250_000
#: Bits of the smallest parity sketch, and earlier keys that tell whether a pair was met before.
SKETCH_BITS, EARLIER = 512, 8
#: Rows of wanted classes (24 bytes each) up to which they are broadcast to the documents; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 250_000
#: Bytes of text shingled at once; each needs some fifty bytes of arrays.
PIECE = 1 << 20

_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each place of a word (modulo PLACES): sums of them are word hashes.
PLACES = 64
_TABLE = _mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * _GOLD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of the texts, A-Z lower-cased, and each text's count of words."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = _BLANK[data]
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    size = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - start
    at = np.flatnonzero(~blank)
    first = np.cumsum(size) - size
    place = at - np.repeat(start, size)
    values = _TABLE[(place % PLACES) * 256 + _LOWER[data[at]]]
    far = np.flatnonzero(place >= PLACES)  # only these bytes: a word's hash depends on nothing but the word
    values[far] = _mix(values[far] + (place[far] // PLACES).astype(np.uint64) * _GOLD)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, ends, side="left"), prepend=0)
    hashes = np.add.reduceat(values, first) if len(first) else np.empty(0, np.uint64)
    return _mix(hashes + size.astype(np.uint64) * _GOLD), counts


def _combined(hashes: np.ndarray, width: int) -> np.ndarray:
    acc = np.full(max(0, len(hashes) - width + 1), width, np.uint64)
    for i in range(width):
        acc = _mix(acc * _GOLD + hashes[i : i + len(acc)])
    return acc


def shingle_sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word k-shingles."""
    hashes, counts = _word_hashes([t or b"" for t in texts])
    all_ = _combined(hashes, k)
    out, start = [], 0
    for n in counts:
        if n >= k:
            s = np.sort(all_[start : start + n - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(_combined(hashes[start : start + n], n) if n else np.empty(0, np.uint64))
        start += n
    return out


def _class_of(s: np.ndarray, clashing: frozenset[int] = frozenset()) -> int | None:
    """The class of a set: a hash, or the second one where the first is known to name several sets."""
    if not len(s):
        return None
    first, second = _two_hashes(s)
    return second if first in clashing else first


def _two_hashes(s: np.ndarray) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(int(np.uint64(x).astype(np.int64)) for x in (both & (1 << 64) - 1, both >> 64))


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the elements dealt over a power of two of bits, two to four for each element.
    Two sketches differ in at most as many bits as the sets do in elements; a wide one, its
    halves exclusively ored, is the sketch of half the width."""
    bits = max(SKETCH_BITS, 2 << (len(s) - 1).bit_length())
    odd = np.bincount((_mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(sketch: np.ndarray) -> np.ndarray:
    """The sketch at the smallest width."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, SKETCH_BITS // 64), axis=0)


class _Threshold:
    """Jaccard >= percent/100 in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def least_overlap(self, n: int) -> int:
        """The overlap that a set of n needs with any partner."""
        return -(-self.percent * n // 100)

    def largest_partner(self, n, left):
        """The largest partner of a set of n of which at most `left` elements can still be shared: t*(n+m) <= (100+t)*left."""
        return (100 + self.percent) * left // self.percent - n

    def linked(self, shared: int, n: int, m: int) -> bool:
        return 100 * shared >= self.percent * (n + m - shared)


def choose_boundary(sizes: dict[int, int], scan: float | dict[int, float], percent: int = 75) -> int:
    """The size up to which sets enumerate 2-subsets. Cost of a light set: its 2-subsets, and
    its prefix too where a heavy set may be its partner; of a heavy one: its prefix times the
    mean length of the lists that its entries meet. scan: that length, or that of each size."""
    t = _Threshold(percent)
    low = [n for n in sorted(sizes) if 2 < n <= LARGEST_LIGHT]
    p = np.array([n - t.least_overlap(n) + 1 for n in low], float)
    c = np.array([sizes[n] for n in low], float)
    heavy = c * p * np.array([scan.get(n, 1.0) if isinstance(scan, dict) else scan for n in low])
    light = c * p * (p + 1) / 2
    size = np.array(low)
    costs = {x: float(np.where(size <= x, light + heavy * (size >= t.least_overlap(x + 1)), heavy).sum()) for x in [2, *low]}
    return min(costs, key=lambda x: (costs[x], x))


def _tag() -> Column:
    """What finds a document again, with its text's hash: its id, else that hash."""
    return F.coalesce("doc_id", F.xxhash64("text")).alias("tag")


def _scan_docs(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (kind 0: doc_id, tag, text_hash, n, class, check: the class's second hash, and for a set
    that is new to its block its sketches), (kind 1:
    shingle, count) for shingles repeated among the distinct sets of a block of a task, and
    (kind 2: key: set size, n: prefix entries of that size, check: entries of the block's lists that they meet)."""
    t = _Threshold(percent)

    def make():
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []  # each distinct set of the block

        def close() -> tuple:
            """The repeated shingles of the block and the lists met by its sets."""
            if not held:
                return np.empty(0, np.uint64), np.empty(0, np.int64), {}
            sets = held[:]
            held.clear()
            seen.clear()
            u, inverse, c = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            met: dict[int, list[int]] = {}
            at = 0
            for s in sets:
                n = len(s)
                if 2 < n <= LARGEST_LIGHT:
                    p = n - t.least_overlap(n) + 1
                    lists = np.partition(c[inverse[at : at + n]], p - 1)[:p]
                    cell = met.setdefault(n, [0, 0])
                    cell[0] += p
                    cell[1] += int(lists.sum())
                at += n
            return u[c > 1], c[c > 1], met

        def step(piece: pa.RecordBatch) -> dict:
            ids, sizes, classes, checks, wide, small = [piece[c].to_pylist() for c in ("doc_id", "tag", "text_hash")], [], [], [], [], []
            for s in shingle_sets(piece["text"].cast(pa.binary()).to_pylist(), k):
                c, check = _two_hashes(s) if len(s) else (None, None)
                sizes.append(len(s))
                classes.append(c)
                checks.append(check)
                new = c is not None and (c, check) not in seen
                if new:
                    seen.add((c, check))
                    held.append(s)
                wide.append(_sketch(s) if new and len(s) > 2 else None)
                small.append(None if wide[-1] is None else _folded(wide[-1]))
            return _rows(ids, sizes, classes, checks, (wide, small), *(close() if sum(map(len, held)) >= COUNT_BLOCK else (np.empty(0, np.uint64), np.empty(0, np.int64), {})))

        step.last = lambda: _rows(([], [], []), [], [], [], ([], []), *close())
        return step

    def _rows(ids, sizes, classes, checks, sketches, hashes, counts, met):
        m, g = len(hashes), len(met)
        none = [None] * (m + g)
        return {
            "kind": [0] * len(sizes) + [1] * m + [2] * g,
            "doc_id": ids[0] + none,
            "tag": ids[1] + none,
            "text_hash": ids[2] + none,
            "n": sizes + counts.tolist() + [x[0] for x in met.values()],
            "key": classes + hashes.astype(np.int64).tolist() + list(met),
            "check": checks + [None] * m + [x[1] for x in met.values()],
            "sketch": sketches[0] + none,
            "small": sketches[1] + none,
        }

    return _map_with_last(docs.select("doc_id", "text", _tag(), F.xxhash64("text").alias("text_hash")), "kind int, doc_id long, tag long, text_hash long, n long, key long, check long, sketch array<long>, small array<long>", make)


def _map_with_last(df: DataFrame, schema: str, make) -> DataFrame:
    """map_pieces for a step that has rows left at the end of its task."""
    from maskspark.llm.common import _arrow_schema, forget, pieces

    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        forget()
        step = make()
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                yield pa.RecordBatch.from_pydict(step(piece), schema=arrow)
        yield pa.RecordBatch.from_pydict(step.last(), schema=arrow)

    return df.mapInArrow(run, schema)


@dataclass
class _Order:
    """The global order: frequent shingles by hash, each with its rank (rarest first) and the parts of its list (0: one)."""

    hashes: np.ndarray
    ranks: np.ndarray
    parts: np.ndarray

    def sorted(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """s in the global order (shingles without a rank by hash, then the ranked ones), and the parts of each one's list."""
        if not len(self.hashes):
            return s, np.zeros(len(s), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
        known = self.hashes[at] == s
        order = np.argsort(np.where(known, self.ranks[at] + 1, 0), kind="stable") if known.any() else np.arange(len(s))
        return s[order], np.where(known, self.parts[at], 0)[order].astype(np.int32)


def _global_order(counts: DataFrame, long_list: int) -> _Order:
    """The order from rows (key, n) of the first pass."""
    frequent = counts.groupBy("key").agg(F.sum("n").alias("c")).where("c >= 4").orderBy(F.desc("c"), "key").limit(RANKED_SHINGLES).toArrow()
    hashes, c = frequent["key"].to_numpy().astype(np.int64).view(np.uint64), frequent["c"].to_numpy().astype(np.int64)
    by_hash = np.argsort(hashes)
    ranks = np.empty(len(hashes), np.int32)
    ranks[np.lexsort((hashes, c))] = np.arange(len(hashes), dtype=np.int32)
    parts = np.where(c > long_list, -(-c // long_list), 0).astype(np.int32)
    return _Order(hashes[by_hash], ranks[by_hash], parts[by_hash])


def _entries(s: np.ndarray, parts: np.ndarray, boundary: int, t: _Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set in the global order, their places and their lists' parts: heavy keys have
    place >= 0, the position; light ones -1 - (j * 1024 + i) for the positions i < j."""
    n = len(s)
    need = t.least_overlap(n)
    keys, places, dealt = [], [], []
    if n > boundary or n >= t.least_overlap(boundary + 1):
        p = n - need + 1
        keys.append(s[:p])
        places.append(np.arange(p))
        dealt.append(parts[:p])
    if n <= boundary:
        j, i = np.tril_indices(n - need + 2, -1)
        keys.append(_mix((s[i] * _GOLD) ^ _mix(s[j] + _GOLD)))
        places.append(-1 - (j * 1024 + i))
        dealt.append(np.minimum(parts[i], parts[j]))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(dealt)


def _postings(docs: DataFrame, k: int, boundary: int, percent: int, order, clashing: frozenset[int]) -> DataFrame:
    """(key, part, class, n, place) of every set that can link with another one; once for each set and task. part: -1 but in long lists."""

    def make():
        t, ordered = _Threshold(percent), order().sorted
        seen: set[tuple[int, int]] = set()

        def step(piece: pa.RecordBatch) -> dict:
            found: list[list[np.ndarray]] = [[], [], [], [], []]
            for s in shingle_sets(piece["text"].cast(pa.binary()).to_pylist(), k):
                c = _class_of(s, clashing)
                if len(s) < 3 or c in seen:  # smaller sets link with equal ones only
                    continue
                seen.add(c)
                key, place, parts = _entries(*ordered(s), boundary, t)
                part = np.where(parts > 0, np.int64(c) % np.maximum(parts, 1).astype(np.int64), -1)
                for out, x in zip(found, (key.astype(np.int64), part.astype(np.int32), np.full(len(key), c, np.int64), np.full(len(key), len(s), np.int32), place.astype(np.int32)), strict=True):
                    out.append(x)
            kinds = (np.int64, np.int32, np.int64, np.int32, np.int32)
            return {name: pa.array(np.concatenate(x) if x else np.empty(0, kind)) for name, x, kind in zip(("key", "part", "cls", "n", "place"), found, kinds, strict=True)}

        return step

    return map_pieces(docs.select("text"), "text", "key long, part int, cls long, n int, place int", make, PIECE)


def _apart(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ, at the width of the smaller: a lower bound of the sets' symmetric difference. Partners differ in size by a third at most, so one fold does."""
    at = F.least(F.size(x), F.size(y))
    halves = lambda s: F.zip_with(F.slice(s, F.lit(1), at), F.slice(s, at + 1, at), lambda a, b: a.bitwiseXOR(b))
    folded = lambda s: F.when(F.size(s) == at, s).otherwise(halves(s))
    return F.aggregate(F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("int")), F.lit(0), lambda n, d: n + F.coalesce(d, F.lit(0)))


def _in_reach(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, bytes of both sets) of the pairs (a, b) whose sketches leave the threshold in reach."""
    named = lambda s: sketches.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    return both.where((100 + percent) * _apart(F.col("sketch_a"), F.col("sketch_b")) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b", (8 * (F.col("n_a").cast("long") + F.col("n_b"))).alias("bytes"))


def _sets(docs: DataFrame, standing: DataFrame, pairs: DataFrame, k: int, clashing: frozenset[int], broadcast_rows: int) -> DataFrame:
    """(cls, elements) of the classes in pairs, once for each task that meets a text of one. standing: cls, tag, text_hash of one text of each class."""
    wanted = materialize(standing.join(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "cls", "left_semi").select("cls", "tag", "text_hash"), "wanted")
    texts = docs.select("text", _tag(), F.xxhash64("text").alias("text_hash"))
    found = texts.join(F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted.hint("merge"), ["tag", "text_hash"]).select("cls", "text")

    def make():
        seen: set[tuple[int, int]] = set()

        def step(piece: pa.RecordBatch) -> dict:
            out: dict = {"cls": [], "elements": []}
            for c, s in zip(piece["cls"].to_pylist(), shingle_sets(piece["text"].cast(pa.binary()).to_pylist(), k), strict=True):
                if c not in seen and _class_of(s, clashing) == c:
                    seen.add(c)
                    out["cls"].append(c)
                    out["elements"].append(s.tobytes())
            return out

        return step

    return materialize(map_pieces(found, "text", "cls long, elements binary", make, PIECE), "sets")


def _blocks(pairs: DataFrame, size: int) -> DataFrame:
    """(a, b, block) of pairs (a, b, bytes). Pairs around one class come together, so that a set
    travels about once; a crowd of more than size bytes is dealt over a grid by both ends, and a
    cell that is still larger by the pairs themselves."""
    low = materialize(pairs.select("a", "b").union(pairs.select("b", "a")).groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "low")
    named = pairs.join(low, "a").join(low.toDF("b", "low_b"), "b").select("a", "b", "bytes", F.least("low", "low_b").alias("low"))
    parts = lambda name: F.ceil(F.sum("bytes") / size).cast("long").alias(name)
    crowd = materialize(named.groupBy("low").agg(parts("crowd")), "crowd")
    side = F.ceil(F.sqrt("crowd"))
    cells = named.join(crowd, "low").select("a", "b", "bytes", "low", F.pmod(F.xxhash64("a"), side).alias("i"), F.pmod(F.xxhash64("b"), side).alias("j"))
    cells = materialize(cells, "cells")
    over = materialize(cells.groupBy("low", "i", "j").agg(parts("over"), F.sum("bytes").alias("total")), "over")
    blocks = max(1, int((over.agg(F.sum("total")).first()[0] or 0) // size))
    return cells.join(over, ["low", "i", "j"]).select("a", "b", F.pmod(F.xxhash64("low", "i", "j", F.pmod(F.xxhash64("a", "b"), "over")), F.lit(blocks)).cast("int").alias("block"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, size: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) among pairs (a, b, bytes) of classes: of those in a block as many as connect what all its links connect."""
    named = materialize(_blocks(pairs, size), "blocks")
    wanted = named.select(F.col("block").alias("into"), F.col("a").alias("cls")).union(named.select("block", "b")).distinct()
    found = sets.select("cls", "elements").join(wanted, "cls").select("into", "cls", "elements")

    def compare(these: pa.Table, held: pa.Table) -> pa.Table:
        t, join = _Threshold(percent), _Forest()
        sets = {c: np.frombuffer(x.as_buffer(), np.uint64) for c, x in zip(held["cls"].to_pylist(), held["elements"], strict=True)}
        keep = []
        for a, b in sorted(zip(these["a"].to_pylist(), these["b"].to_pylist(), strict=True)):
            if not join.same(a, b) and t.linked(_shared(sets[a], sets[b]), len(sets[a]), len(sets[b])):
                join.unite(a, b)
                keep.append((a, b))
        return pa.table({"a": pa.array([x[0] for x in keep], pa.int64()), "b": pa.array([x[1] for x in keep], pa.int64())})

    return named.groupBy("block").cogroup(found.groupBy("into")).applyInArrow(compare, "a long, b long")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


class _Forest:
    """Union and find, each tree named by its least node."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, top = self.up, x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def same(self, a: int, b: int) -> bool:
        return self.find(a) == self.find(b)

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: each task's edges as stars around their least nodes."""

    def run(batches):
        join = _Forest()
        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                join.unite(a, b)
        nodes = [x for x in join.up if join.find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([join.find(x) for x in nodes], pa.int64())], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b); root is the component's smallest
    node. Each task contracts its edges first, then what is left is contracted again in as few
    tasks as task_edges allows: one task leaves stars. Of more tasks, large-star and small-star
    alternate. Every frame that is joined is written to the shared folder first, so that skewed
    joins can be split."""
    edges = materialize(_contracted(edges.where("a <> b")), "edges")
    tasks = max(1, -(-edges.count() // task_edges))
    edges = materialize(_contracted(edges.coalesce(tasks)), "edges")
    if tasks == 1:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
    edges = materialize(edges.distinct(), "edges")
    while True:
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        both = edges.union(edges.select("b", "a"))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = materialize(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select("b", "m").union(low)
        edges = materialize(small.toDF("a", "b").where("a <> b").distinct(), "edges")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, class_id (the set's hash; null
    for empty sets), component_id (smallest doc_id reachable by links)."""
    return linked(docs, k, percent).select("doc_id", "n_shingles", "class_id", "component_id")


def linked(docs: DataFrame, k: int = 5, percent: int = 75, long_list: int = LONG_LIST, block_bytes: int = BLOCK_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of jaccard_components() and text_hash (xxhash64 of the text) and root: the component's smallest class, also without ids; null for empty sets."""
    spark = docs.sparkSession
    scan = materialize(_scan_docs(docs, k, percent), "scan")
    ids = scan.where("kind = 0").select("doc_id", "tag", "text_hash", F.col("n").cast("int").alias("n_shingles"), F.col("key").alias("cls"), "check", "sketch", "small")
    order = share(spark, _global_order(scan.where("kind = 1").select("key", "n"), long_list))  # RANKED_SHINGLES entries at most
    # First hashes that name several sets: some n^2 / 2^65 of n sets, so a handful at any size.
    clashing = frozenset(r[0] for r in ids.where("cls is not null").groupBy("cls").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").select("cls").collect())
    if clashing:
        ids = ids.withColumn("cls", F.when(F.col("cls").isin(*clashing), F.col("check")).otherwise(F.col("cls")))
    boundary = choose_boundary(
        {r[0]: r[1] for r in ids.where(f"n_shingles <= {LARGEST_LIGHT}").groupBy("n_shingles").count().collect()},  # LARGEST_LIGHT rows at most
        {r[0]: r[2] / r[1] for r in scan.where("kind = 2").groupBy("key").agg(F.sum("n"), F.sum("check")).collect()},  # as many
        percent,
    )
    standing = materialize(ids.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("tag", "text_hash")).alias("x")).select("cls", "doc_id", "x.tag", "x.text_hash"), "standing")

    entry = _postings(docs, k, boundary, percent, order, clashing).repartition("key", "part").distinct()
    left = F.col("n") - F.when(F.col("place") >= 0, F.col("place")).otherwise(F.floor((-1 - F.col("place")) / 1024).cast("int") - 1)
    entry = entry.withColumn("cap", (F.floor(left.cast("long") * (100 + percent) / percent) - F.col("n")).cast("int"))
    mates = Window.partitionBy("key", "part")
    live = entry.withColumns({"held": F.count(F.lit(1)).over(mates), "least": F.min("n").over(mates), "most": F.max("cap").over(mates)})
    live = live.where("part >= 0 or (held > 1 and least <= cap and n <= most)").select("key", "part", "cls", "n", "place", "cap")
    live = materialize(live, "live")
    release(spark)

    sketches = ids.where("sketch is not null").select("cls", F.col("n_shingles").alias("n"), "sketch", "small")
    sketches = materialize(sketches.join(live.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "sketches")

    fits = lambda x, y: (F.col(f"{x}n") <= F.col(f"{y}cap")) & (F.col(f"{y}n") <= F.col(f"{x}cap")) & ((F.col(f"{x}place") < 0) | (F.greatest(F.col(f"{x}n"), F.col(f"{y}n")) > boundary))
    pair = lambda x, y: (F.least(f"{x}cls", f"{y}cls").alias("a"), F.greatest(f"{x}cls", f"{y}cls").alias("b"))
    w = Window.partitionBy("key", "part").orderBy(F.xxhash64("cls", F.lit(17)), "cls")
    me = F.struct("cls", "n", "cap", "place")
    near = live.select(me.alias("me"), F.array_compact(F.array(*(F.lead(me, s).over(w) for s in range(1, NEIGHBOURS + 1)))).alias("next")).select("me", F.explode("next").alias("you"))
    tried = materialize(near.where(fits("me.", "you.")).select(*pair("me.", "you.")).distinct(), "pairs")
    pairs = materialize(_in_reach(tried, sketches, percent), "pairs")
    release(spark)
    roots = components(_verified(pairs, _sets(docs, standing, pairs, k, clashing, broadcast_rows), percent, block_bytes))
    release(spark)

    # Pairs across components; lists within one component are done.
    member = live.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    member = materialize(member, "member")
    parts = member.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = materialize(parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "root")).alias("main")).where("parts > 1").select("key", F.col("main.root").alias("main")), "main")
    open_ = materialize(member.join(main, "key"), "open")
    # Both sets follow one order, so a common key mostly has another one just before it: such a pair was met there.
    before = Window.partitionBy("cls", F.col("place") < 0).orderBy(F.abs("place"), "place", "key").rowsBetween(-EARLIER, -1)
    open_ = materialize(open_.withColumn("earlier", F.collect_list("key").over(before)).join(sketches.select("cls", "small"), "cls"), "open")
    release(spark)
    few = open_.where("root <> main").alias("x")
    all_ = open_.alias("y")
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col("x.small")[i].bitwiseXOR(F.col("y.small")[i])) for i in range(SKETCH_BITS // 64)))
    rest = few.join(
        all_,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.root") != F.col("y.root"))
        & ((F.col("y.root") == F.col("y.main")) | (F.col("x.cls") < F.col("y.cls")))
        & fits("x.", "y.")
        & ((100 + percent) * apart <= (100 - percent) * (F.col("x.n") + F.col("y.n")))
        & ~F.arrays_overlap("x.earlier", "y.earlier"),
    )
    rest = rest.select(*pair("x.", "y.")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = materialize(_in_reach(rest, sketches, percent), "rest")
    release(spark)
    more = _verified(rest, _sets(docs, standing, rest, k, clashing, broadcast_rows), percent, block_bytes)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    named = materialize(standing.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root")), "named")
    least = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    named = materialize(named.join(least, "root").select("cls", "root", "component_id"), "classes")
    release(spark)
    return ids.drop("sketch", "small").join(named, "cls", "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("cls").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "root")
