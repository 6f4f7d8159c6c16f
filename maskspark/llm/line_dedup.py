"""Line dedup: lines that repeat across documents stay in one of them only.

A line's key is the line without white space at both ends and with A-Z lower-cased, known by its
128-bit hash. One pass over the texts gives, for each distinct key, its smallest doc_id and the
number of rows that hold it; keys found in two documents are repeated. The repeated keys are cut
into shards, and each shard gets a minimal perfect hash: levels of bits, where a key that is alone
in its place on a level is settled there and its number is its rank among all settled places. That
number indexes three arrays: a 64-bit fingerprint, the count and the owner (the document that keeps
the line). Documents probe these arrays line by line; there is no join of lines with keys.

Two tiers. Of all rows that hold repeated keys, L in number, at most HEAD_KEYS keys can each be in
more than L / HEAD_KEYS. Their shards are broadcast, which is bounded by HEAD_KEYS * 21 bytes
whatever the input, and probed where the text is. Rarer keys' shards stay distributed: the lines
that the head does not hold travel as hashes to the shard that may hold them, stream past it, and
only those to be dropped come back. A rare key has a bounded share of all lines, so no shard is hot.

Hashes and fingerprints: distinct lines count as one only if 128 bits agree, and a line that is not
repeated passes for a repeated one only if it meets a fingerprint of 64 bits.

Edge cases. Null or empty text is one empty line. Rows that repeat a doc_id count as one document:
they keep or lose a line together. Rows without doc_id count together as one document after all
ids, so they own no line that another document has. Ties do not occur: owners are smallest ids.
Very long texts are cut into lines whole. Columns other than doc_id and text are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.llm.common import map_pieces, materialize, per_worker, share, texts

#: Code points of the shortest key that is compared.
LEAST_LENGTH = 10
#: Keys that are broadcast at most: 2^20 keys are 21 MB of arrays.
HEAD_KEYS = 1 << 20
#: Keys of one shard, about; a shard is built and probed in one task.
SHARD_KEYS = 1 << 15
#: Places on a level of the perfect hash for each key that is still unsettled.
PLACES_PER_KEY = 2

SHARD = "shard int, levels binary, sizes array<int>, prints binary, counts binary, owners binary"
_TEXT = "doc_id long, text string"


def line_keys(lines: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place, 128-bit hash) of each line whose key is long enough."""
    for i, line in enumerate(lines):
        if len(line) >= LEAST_LENGTH:
            key = line.strip().lower()  # of bytes: white space and letters of ASCII only
            if len(key) >= 4 * LEAST_LENGTH or len(key) >= LEAST_LENGTH and len(key.decode()) >= LEAST_LENGTH:
                yield i, xxhash.xxh3_128_digest(key)


def repeated_keys(docs: DataFrame) -> DataFrame:
    """h1, h2, n, owner of each key found in two documents at least: n counts rows that hold it."""

    def make():
        def step(piece: pa.RecordBatch) -> dict:
            found: dict[bytes, list] = {}
            for doc, text in zip(piece["doc_id"].to_pylist(), texts(piece), strict=True):
                for key in {k for _, k in line_keys(text.encode().split(b"\n"))}:
                    held = found.get(key)
                    if held is None:
                        found[key] = [1, doc, doc, doc is None]
                    else:
                        held[0] += 1
                        if doc is None:
                            held[3] = True
                        else:
                            held[1] = doc if held[1] is None or doc < held[1] else held[1]
                            held[2] = doc if held[2] is None or doc > held[2] else held[2]
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            n, first, last, unnamed = zip(*found.values(), strict=True) if found else ((), (), (), ())
            return {"h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1]), "n": list(n), "first": list(first), "last": list(last), "unnamed": list(unnamed)}

        return step

    seen = map_pieces(docs.select("doc_id", "text"), "text", "h1 long, h2 long, n long, first long, last long, unnamed boolean", make)
    keys = seen.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("first").alias("owner"), F.max("last").alias("last"), F.max("unnamed").alias("unnamed"))
    return keys.where("owner < last or (owner is not null and unnamed)").select("h1", "h2", "n", "owner")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h1 + _mix(h2 + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(size)


class PerfectHash:
    """Numbers 0 .. n-1 for n distinct pairs of words; other pairs get any number or none (-1)."""

    def __init__(self, levels: np.ndarray, sizes: np.ndarray) -> None:
        self.bits, self.sizes = levels, sizes
        self.starts = np.cumsum(sizes) - sizes
        words = np.bitwise_count(levels.view(np.uint64)).astype(np.int64)
        self.before = np.cumsum(words) - words

    @staticmethod
    def build(h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels, sizes = [], []
        rest = np.arange(len(h1))
        while len(rest):
            size = -(-PLACES_PER_KEY * len(rest) // 64) * 64  # whole words
            at = _place(h1[rest], h2[rest], len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            rest = rest[~alone[at]]
        return PerfectHash(np.concatenate(levels) if levels else np.empty(0, np.uint8), np.array(sizes, np.int64))

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        rest = np.arange(len(h1))
        words = self.bits.view(np.uint64)
        for level, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            at = _place(h1[rest], h2[rest], level, int(size)).astype(np.int64) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            out[rest[hit]] = self.before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1)))
            rest = rest[~hit]
        return out


def _print_of(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h2 ^ _mix(h1))


class Shard:
    """The perfect hash of one shard and its arrays."""

    def __init__(self, row: dict) -> None:
        self.number = PerfectHash(np.frombuffer(row["levels"], np.uint8), np.array(row["sizes"], np.int64))
        self.prints, self.counts, self.owners = (np.frombuffer(row[c], t) for c, t in (("prints", np.uint64), ("counts", np.uint32), ("owners", np.int64)))

    @staticmethod
    def columns(h: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> dict:
        h1, h2 = h[:, 0].view(np.uint64), h[:, 1].view(np.uint64)
        hash_ = PerfectHash.build(h1, h2)
        order = np.argsort(hash_(h1, h2))  # numbers are 0 .. n-1, each once
        arrays = {"prints": _print_of(h1, h2)[order], "counts": np.minimum(counts, (1 << 32) - 1).astype(np.uint32)[order], "owners": owners[order]}
        return {"levels": hash_.bits.tobytes(), "sizes": hash_.sizes.tolist()} | {k: v.tobytes() for k, v in arrays.items()}

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each key, 0 where it is not here, and its owner."""
        n = self.number(h1, h2)
        here = n >= 0
        here[here] = self.prints[n[here]] == _print_of(h1[here], h2[here])
        counts, owners = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        counts[here], owners[here] = self.counts[n[here]], self.owners[n[here]]
        return counts, owners


def shards(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """One row for each shard of keys(h1, h2, n, owner), and the number of shards; a shard has about SHARD_KEYS keys."""
    count = max(1, -(-n_keys // SHARD_KEYS))

    def build(group: pa.Table) -> pa.Table:
        h = np.stack([group["h1"].to_numpy(), group["h2"].to_numpy()], 1)
        row = {"shard": group["shard"][0].as_py()} | Shard.columns(h, group["n"].to_numpy(), group["owner"].to_numpy())
        return pa.table({k: pa.array([v], pa.list_(pa.int32()) if k == "sizes" else pa.int32() if k == "shard" else pa.binary()) for k, v in row.items()})

    dealt = keys.select(F.pmod("h1", F.lit(count)).cast("int").alias("shard"), "h1", "h2", "n", "owner")
    return dealt.groupBy("shard").applyInArrow(build, SHARD), count


class Head:
    """The broadcast shards, probed for any keys at once."""

    def __init__(self, rows: list[dict], count: int) -> None:
        self.count, self.shards = count, {r["shard"]: Shard(r) for r in rows}

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, owners = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        shard = h[:, 0] % self.count
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            held = self.shards.get(int(shard[part[0]])) if len(part) else None
            if held:
                counts[part], owners[part] = held.probe(h[part, 0].view(np.uint64), h[part, 1].view(np.uint64))
        return counts, owners


def _lines_of(piece: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """The lines of each text, and row, place and hash of every key."""
    split = [t.encode().split(b"\n") for t in texts(piece)]
    rows, places, keys = [], [], []
    for r, lines in enumerate(split):
        for i, key in line_keys(lines):
            rows.append(r)
            places.append(i)
            keys.append(key)
    return split, np.array(rows, np.int64), np.array(places, np.int64), np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


def _foreign(piece: pa.RecordBatch, rows: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Whether the row's document is another than the owner; a row without id owns nothing."""
    ids = piece["doc_id"].is_null().to_numpy(zero_copy_only=False), piece["doc_id"].fill_null(0).to_numpy()
    return ids[0][rows] | (ids[1][rows] != owners)


def _text_tag(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def _tail_drops(docs: DataFrame, tail: DataFrame, count: int, head) -> DataFrame:
    """doc_id, tag and places of the lines that the distributed shards tell to drop. The probes of a shard stream past its arrays."""

    def make():
        held = head()

        def step(piece: pa.RecordBatch) -> dict:
            _, rows, places, h = _lines_of(piece)
            left = held.probe(h)[0] == 0
            rows, places, h = rows[left], places[left], h[left]
            tags = np.array([_text_tag(t) for t in texts(piece)], np.int64)
            return {"shard": pa.array((h[:, 0] % count).astype(np.int32)), "h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1]), "doc_id": piece["doc_id"].take(pa.array(rows)), "tag": pa.array(tags[rows] if len(rows) else rows), "place": pa.array(places)}

        return step

    probes = map_pieces(docs.select("doc_id", "text"), "text", "shard int, h1 long, h2 long, doc_id long, tag long, place long", make)
    arrays = SHARD.split(", ")[1:]
    both = probes.withColumn("probe", F.lit(1)).select("*", *(F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in arrays)).unionByName(tail.withColumn("probe", F.lit(0)), allowMissingColumns=True)
    together = both.repartition("shard").sortWithinPartitions("shard", "probe")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = at = None
        for batch in batches:
            shard = batch["shard"].to_numpy()
            for part in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                rows = batch.slice(part[0], len(part)) if len(part) else None
                if rows is None:
                    continue
                if rows["probe"][0].as_py() == 0:  # arrays come before the probes of their shard
                    held, at = Shard({c.split(" ")[0]: rows[c.split(" ")[0]][0].as_py() for c in arrays}), shard[part[0]]
                    rows = rows.slice(1)
                if at != shard[part[0]] or not len(rows):
                    continue
                counts, owners = held.probe(rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64))
                gone = (counts > 0) & _foreign(rows, np.arange(len(rows)), owners)
                columns = [rows[c].filter(pa.array(gone)) for c in ("doc_id", "tag", "place")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[gone])], ["doc_id", "tag", "place", "copies"])

    found = together.mapInArrow(probe, "doc_id long, tag long, place long, copies long")
    return found.groupBy(F.col("doc_id").alias("drop_id"), F.col("tag").alias("drop_tag")).agg(F.collect_set("place").alias("places"), F.max("copies").alias("copies"))


def drop_repeated_lines(docs: DataFrame, head_keys: int = HEAD_KEYS) -> DataFrame:
    """doc_id, text without the lines that another document owns, n_lines before, n_dropped, and
    most_copies, the number of rows that hold the most common of the dropped lines, of every row."""
    docs = docs.select("doc_id", "text")
    keys = materialize(repeated_keys(docs), "line-keys")
    n_keys, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    border = total / head_keys
    in_head = F.col("n") > border
    n_head = keys.where(in_head).count()  # below head_keys, as each has more than that share of the total
    first, head_count = shards(keys.where(in_head), n_head)
    rows = [r.asDict() for r in first.collect()] if n_head else []
    packed, name = share(docs.sparkSession, (rows, head_count)), uuid.uuid4().hex

    def head() -> Head:
        return per_worker(("line-head", name), lambda: Head(*packed()))

    if n_head < n_keys:
        tail, count = shards(keys.where(~in_head), n_keys - n_head)
        drops = materialize(_tail_drops(docs, materialize(tail, "line-shards"), count, head), "line-drops")
        tagged = map_pieces(docs, "text", f"{_TEXT}, tag long", lambda: lambda piece: {"doc_id": piece["doc_id"], "text": piece["text"], "tag": [_text_tag(t) for t in texts(piece)]})
        docs = tagged.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("tag") == F.col("drop_tag")), "left").select("doc_id", "text", "places", "copies")
    else:
        docs = docs.select("doc_id", "text", F.lit(None).cast("array<long>").alias("places"), F.lit(0).cast("long").alias("copies"))

    def make():
        held = head()

        def step(piece: pa.RecordBatch) -> dict:
            split, rows, places, h = _lines_of(piece)
            counts, owners = held.probe(h)
            gone: list[set[int]] = [set(p or ()) for p in piece["places"].to_pylist()]
            most = piece["copies"].fill_null(0).to_numpy().copy()
            lost = (counts > 0) & _foreign(piece, rows, owners)
            np.maximum.at(most, rows[lost], counts[lost])
            for r, i in zip(rows[lost].tolist(), places[lost].tolist(), strict=True):
                gone[r].add(i)
            kept = [b"\n".join(x for i, x in enumerate(lines) if i not in g) if g else b"\n".join(lines) for lines, g in zip(split, gone, strict=True)]
            return {"doc_id": piece["doc_id"], "text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": [len(x) for x in split], "n_dropped": [len(g) for g in gone], "most_copies": pa.array(most)}

        return step

    return map_pieces(docs, "text", f"{_TEXT}, n_lines long, n_dropped long, most_copies long", make)
