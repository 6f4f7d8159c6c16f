"""Best-fit packing by a configuration linear program.

Texts become token ids with an end id; longer documents are cut. The pieces' length histogram
defines the linear program over configurations (multisets of lengths that fit a sequence):
multiplicative weights hold a price for each length, knapsack dynamic programming finds the
configuration of most price, and the averaged plan is scaled to the bound and rounded down. What
rounding leaves is packed best fit, longest first, over the histogram alone. Any prices over the
most that they give a configuration bound the number of sequences from below: the best such bound
is returned as least_sequences, and the rounds end when a rounded plan meets it, when every length
is covered, or when the bound has stopped to grow. Ranks within each length, counted by buckets
that follow the counts, then assign pieces to the plan's places, so no task holds more than a bucket.

Edge cases. Null counts as empty text: one piece, the end id. Repeated rows each give their
pieces and places. Null doc_id is kept. Extra columns are ignored. An empty table gives an empty
result. Whole texts are encoded, of any length. A tokenizer file of another kind than the one that
the fast path knows is used as it is, text by text.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskspark.llm.common import map_pieces, materialize, per_worker, trim
from maskspark.llm.lexicon import Memory, numbered, put_together

#: The share of a length that a round of multiplicative weights covers, and how far from the best a configuration may be.
STEP, SLACK = 0.2, 0.01
#: Rounds without a better bound (by GAIN of it) after which the program is left.
PATIENCE, GAIN = 40, 1e-4
#: Configurations of the program that a plan keeps, for each unit of the capacity: those used most. What others would hold is packed best fit.
KEPT_CONFIGURATIONS = 4
#: Pieces of one length that are ranked in one bucket, about.
BUCKET = 100_000
#: Words in each of the two generations that a worker remembers.
REMEMBERED = 150_000

#: The parts of a tokenizer file for which words can be encoded apart (fixed values).
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
}
END_OF_WORD = "</w>"


class Encoder:
    """Token ids of texts. For a file of the KNOWN kind by words between blanks: the tokenizer
    drops white space, and no merge spans it. Words of letters alone, lower case and composed, are
    one pre-token each, so many are encoded in one call and told apart by the tokens that end a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory(REMEMBERED)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model = parts["model"]
        self.by_words = all(parts.get(k) == v for k, v in KNOWN.items()) and model["type"] == "BPE" and model.get("end_of_word_suffix") == END_OF_WORD and not model.get("dropout")
        self.by_words = self.by_words and all(x["special"] and x["content"].startswith("<|") for x in parts["added_tokens"])
        if self.by_words:
            self.letters = Tokenizer.from_file(path)
            self.letters.normalizer = None
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.letters.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True

    def _learn(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isascii() and w.isalpha() and w.islower()]
        told = set(plain)
        other = [i for i in range(len(words)) if i not in told]
        self._letters(plain, [words[i] for i in plain], out)
        if other:
            named = self.tokenizer.normalizer.normalize_str(" ".join(words[i] for i in other)).split(" ")
            if len(named) != len(other):  # white space inside a word
                named = [""] * len(other)
            # scripts up to Cyrillic: which of their characters are letters has long been settled
            alone = [(i, w) for i, w in zip(other, named, strict=True) if w.isalpha() and max(w) < "\u0530"]
            self._letters([i for i, _ in alone], [w for _, w in alone], out)
        rest = [i for i in other if out[i] is None]
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.int32).tobytes()
        return out

    def _letters(self, at: list[int], words: list[str], out: list[bytes | None]) -> None:
        """Fills out[at] with the ids of words of letters alone."""
        for a in range(0, len(words), 10_000):
            part = words[a : a + 10_000]
            lines = [" ".join(part[i : i + 100]) for i in range(0, len(part), 100)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.letters.encode_batch_fast(lines, add_special_tokens=False)])
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(part):
                raise ValueError("the tokenizer doesn't end each word with one token")
            raw, before = ids.tobytes(), 0
            for i, end in zip(at[a : a + 10_000], ends, strict=True):
                out[i] = raw[4 * before : 4 * end]
                before = end

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. A mark behind a small letter begins a token of its own anyway (no
        such letter ends in a combining mark when it is normalized), and A-Z is lower-cased anyway,
        so both are done first, which leaves fewer distinct words."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        texts = pc.replace_substring(texts, "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # a special token's name must stay as it is
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"(\p{Ll})([!-&(-/:-@\[-`{-~])", r"\1 \2")
        codes, words, ends = numbered(texts)
        ids, before = put_together(codes, self.memory.find(words, self._learn))
        at = before[ends]
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]


def pieces_of(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of every piece; salt: a number that tells repeated rows of a task apart."""

    def make():
        encoder = per_worker(("packing", path), lambda: Encoder(path))
        last = np.array([end_id], np.int32)
        made = 0

        def step(batch: pa.RecordBatch) -> dict:
            nonlocal made
            out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "salt")}
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
                ids = np.concatenate([ids, last])
                for number, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    made += 1
                    for k, v in zip(out, (doc, number, start, len(part), zlib.crc32(part.tobytes()), made & 0xFFFF), strict=True):
                        out[k].append(v)
            trim()  # the tokenizer frees many small blocks
            return out

        return step

    return map_pieces(docs.select("doc_id", "text"), "text", "doc_id long, piece int, start long, length long, ids_crc32 long, salt int", make)


def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over lengths (ascending): the most price within each room, and the last length taken there (0: none)."""
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    gain = price[lengths]
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = ends[c]
        total = gain[:k] + value[c - lengths[:k]]
        best = int(total.argmax())
        value[c], choice[c] = (total[best], lengths[best]) if total[best] > value[c - 1] else (value[c - 1], 0)
    return value, choice


def _trace(choice: np.ndarray, room: int) -> list[int]:
    found = []
    while room > 0:
        if choice[room]:
            found.append(int(choice[room]))
            room -= found[-1]
        else:
            room -= 1
    return found


def solve_program(count: np.ndarray, capacity: int, done=lambda used, bound: False, most: int | None = None) -> tuple[dict[tuple[int, ...], float], float]:
    """A fractional solution of the configuration program (configuration -> times) and the best
    lower bound met. Prices start at length / capacity; each round prices configurations by one
    knapsack, takes for every length the best configuration that holds it if it is within SLACK of
    the best of all, and multiplies the price of a length by exp(-its new coverage). By duality
    the prices over the best configuration's are a bound. done(solution, bound) is asked after 1, 2, 4, 8 ... rounds; most: rounds at most."""
    need = np.flatnonzero(count)
    price = np.zeros(capacity + 1)
    price[need] = need / capacity
    covered = np.zeros(capacity + 1)
    used: dict[tuple[int, ...], float] = {}
    bound, since, rounds = 0.0, 0, 0
    while True:
        value, choice = knapsack(price, need, capacity)
        total = price[need] + value[capacity - need]
        new = float(price[need] @ count[need]) / float(total.max())
        since = 0 if new > bound * (1 + GAIN) else since + 1
        bound = max(bound, new)
        configs = {tuple(sorted((int(x), *_trace(choice, capacity - int(x))), reverse=True)) for x in need[total >= (1 - SLACK) * total.max()]}
        held = [np.unique(np.array(c), return_counts=True) for c in sorted(configs)]
        sharing = np.zeros(capacity + 1)
        for lengths, times in held:
            sharing[lengths] += 1
        gained = np.zeros(capacity + 1)
        for config, (lengths, times) in zip(sorted(configs), held, strict=True):
            amount = STEP * float((count[lengths] / (times * sharing[lengths])).min())
            used[config] = used.get(config, 0) + amount
            gained[lengths] += amount * times
        covered += gained
        price[need] *= np.exp(-gained[need] / count[need])
        rounds += 1
        if (covered[need] >= count[need]).all() or since >= PATIENCE or rounds == most or (rounds & (rounds - 1) == 0 and done(used, bound)):
            return used, bound


def configuration_plan(count: np.ndarray, capacity: int, rounds: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """The plan of plan_and_bound()."""
    return plan_and_bound(count, capacity, rounds)[0]


def plan_and_bound(count: np.ndarray, capacity: int, rounds: int | None = None) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(configuration, times) so that every length has as many places as count[length]; and a
    number of sequences below which no packing gets."""
    count = count.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    full = int(count[capacity])
    if full:
        plan.append(((capacity,), full))
        count[capacity] = 0
    if not count.any():
        return plan, full
    best: list[tuple[tuple[int, ...], int]] = []

    def rounded(used: dict[tuple[int, ...], float], bound: float) -> bool:
        """Keeps the best rounding of the solution so far (best fit alone is scale 0); whether it meets the bound."""
        nonlocal best
        top = sorted(used.items(), key=lambda x: (-x[1], x[0]))[: KEPT_CONFIGURATIONS * capacity]
        top.sort(key=lambda x: (-sum(x[0]), x[0]))
        whole = bound / sum(used.values())
        for scale in (0.0, 0.5 * whole, 0.8 * whole, 0.95 * whole, whole):
            left, now = count.copy(), []
            for config, amount in top:
                lengths, times = np.unique(np.array(config), return_counts=True)
                n = int(min(math.floor(amount * scale), (left[lengths] // times).min()))
                if n > 0:
                    now.append((config, n))
                    left[lengths] -= n * times
            now += _fill(left, capacity)
            if not best or sum(n for _, n in now) < sum(n for _, n in best):
                best = now
        return sum(n for _, n in best) <= math.ceil(bound - 1e-6)

    used, bound = solve_program(count, capacity, rounded, rounds)
    rounded(used, bound)
    return plan + best, full + math.ceil(bound - 1e-6)


def _fill(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over a histogram: the longest length opens a sequence, which always takes the longest length that still fits; the whole pattern is used as often as it can be."""
    left = left.copy()
    plan = []
    here = [int(x) for x in np.flatnonzero(left)]
    while here:
        config, room, taken = [], capacity, {}
        while room > 0:
            k = bisect_left(here, room + 1) - 1
            while k >= 0 and taken.get(here[k], 0) >= left[here[k]]:
                k -= 1
            if k < 0:
                break
            config.append(here[k])
            taken[here[k]] = taken.get(here[k], 0) + 1
            room -= here[k]
        n = int(min(left[x] // t for x, t in taken.items()))
        plan.append((tuple(config), n))
        for x, t in taken.items():
            left[x] -= n * t
        here = [x for x in here if left[x]]
    return plan


def place_table(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first rank, first sequence, offset and copies of runs of places, by
    rank. A run is all slots of one length in a configuration, over its sequences: no more than
    the configurations of a plan times the distinct lengths that fit a sequence."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for config, times in plan:
        offset = 0
        for x in sorted(set(config), reverse=True):
            copies = config.count(x)
            runs.setdefault(x, []).append((int(ranks[x]), sequence, offset, copies))
            ranks[x] += times * copies
            offset += x * copies
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, bucket: int = BUCKET) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs, and
    least_sequences (of the whole table): a number of sequences below which no packing gets."""
    spark = docs.sparkSession
    cut = materialize(pieces_of(docs, path, capacity, end_id), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # capacity rows at most
        histogram[r["length"]] = r["count"]
    buckets = np.maximum(1, -(-histogram // bucket))
    of_length = F.element_at(F.array(*(F.lit(int(x)) for x in buckets)), (F.col("length") + 1).cast("int"))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), of_length).cast("int"))
    first = np.cumsum(buckets) - buckets  # of each length in `before`: one entry for each bucket
    before = np.zeros(int(buckets.sum()), np.int64)
    for r in cut.groupBy("length", "bucket").count().collect():  # as many rows as `before` has entries, at most
        before[first[r["length"]] + r["bucket"]] = r["count"]
    for x in np.flatnonzero(buckets > 1).tolist():
        mine = before[first[x] : first[x] + buckets[x]]
        mine[:] = np.cumsum(mine) - mine
    before[first[buckets == 1]] = 0
    plan, least = plan_and_bound(histogram, capacity)
    shared = spark.sparkContext.broadcast((first, before, place_table(plan, capacity)))  # one number for each `bucket` pieces, and the bounded runs

    w = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "salt")
    ranked = cut.withColumn("r", F.row_number().over(w) - 1)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("least_sequences", pa.int64())])
        first, before, places = shared.value
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = before[first[length] + batch["bucket"].to_numpy()] + batch["r"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = length == x
                ranks, sequences, offsets, copies = places[int(x)]
                k = np.searchsorted(ranks, rank[mine], side="right") - 1
                at = rank[mine] - ranks[k]
                sequence[mine] = sequences[k] + at // copies[k]
                offset[mine] = offsets[k] + at % copies[k] * x
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in schema.names[:5]), pa.array(sequence), pa.array(offset), pa.array(np.full(len(length), least))], schema=schema)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, least_sequences long")
