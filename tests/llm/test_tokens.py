import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from maskspark.llm.bpe import Codec, encode_and_decode, encode_column
from maskspark.llm.packing import Encoder, configuration_plan, pack, place_table, plan_and_bound

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BITS = ["the", " ", "  ", "\n", "ung", "é", "日本", "'s", "'ll", "12", ",", "!!", "\x1c", "\x85", "\u00a0", "😀", "e\u0301", "ÄÖ", "Σ", "\t", "x" * 40, "_", "<|endoftext|>", "İ", "\u180e", "\r\n"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 12))) for _ in range(n)]


def reference():
    codec = Codec(RANKS, public_tokenizers.PATTERN)
    return codec, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_encoding_as_the_library():
    codec, other = reference()
    r = random.Random(3)
    long_ = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (513, 700, 3000)]
    for text in [*odd_texts(3000, 1), *long_, "a" * 5000]:
        ids = codec.encode(text)
        assert ids.tolist() == other.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_batches_as_single_texts():
    codec, other = reference()
    batch = [*odd_texts(500, 5), " ".join(odd_texts(40, 6)), "one two  three\nfour five", " lead", "trail ", "a b"]
    for text, (ids, shown) in zip(batch, codec.encode_batch(batch), strict=True):
        assert ids.tolist() == other.encode_ordinary(text) and shown == ",".join(map(str, ids))


def test_codec_in_blocks(monkeypatch):
    import maskspark.llm.bpe as m

    codec, other = reference()
    monkeypatch.setattr(m, "BLOCK", 7)
    codec.memory.size = 20
    text = " ".join(odd_texts(60, 9))
    assert codec.encode(text).tolist() == other.encode_ordinary(text)


def test_codec_rows(spark):
    rows = [(1, None), (2, ""), (None, "Hello there"), (3, "x " * 50000), (3, "x " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in encode_and_decode(df, RANKS, public_tokenizers.PATTERN).collect()}
    _, other = reference()
    for doc, text in rows:
        ids = other.encode_ordinary(text or "")
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert [r.ids for r in encode_column(df.where("doc_id = 2"), RANKS, public_tokenizers.PATTERN).collect()] == [[]]
    assert encode_and_decode(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_chunked_ids_as_the_library():
    encoder, other = Encoder(WORDS), Tokenizer.from_file(WORDS)
    for text in [*odd_texts(4000, 2), "A. b, C.d e!. <|ENDOFTEXT|> x.", "The cat. The dog, no."]:
        assert encoder.encode(pa.array([text]))[0].tolist() == other.encode(text, add_special_tokens=False).ids, repr(text)


def test_plan_covers_every_length():
    r = np.random.default_rng(4)
    for lengths in (r.integers(1, 60, 400), r.integers(20, 41, 200), np.array([64, 64, 1]), np.array([3]), np.empty(0, int)):
        count = np.bincount(lengths, minlength=65)
        plan = configuration_plan(count, 64, rounds=40)
        made = np.zeros(65, int)
        for config, n in plan:
            assert sum(config) <= 64 and n > 0
            np.add.at(made, list(config), n)
        assert (made == count).all()
        least = -(-int(lengths.sum()) // 64)
        assert least <= sum(n for _, n in plan) <= max(1.5 * least + 1, (lengths > 32).sum() + 1)
        assert set(place_table(plan, 64)) == set(np.flatnonzero(count))


def test_packing(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["cat", "dog", "unforgettable", "é"]) for _ in range(r.choice((0, 3, 40, 300, 900))))) for i in range(150)] + [(7, "again"), (7, "again"), (None, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS, capacity=256).toPandas()
    other = Tokenizer.from_file(WORDS)
    expected = []
    for doc, text in rows:
        ids = [*other.encode(text or "", add_special_tokens=False).ids, 0]
        expected += [(doc if doc is not None else -1, k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())) for k in range(0, len(ids), 256)]
    assert sorted(expected) == sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype(int).itertuples(index=False, name=None))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()][:-1] and s.length.sum() <= 256
    assert got.sequence_id.nunique() <= 1.05 * got.length.sum() / 256 + 2
    assert pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []


def fewest(pieces, capacity):
    """The least number of sequences, by trying every place for the longest piece left."""
    best = len(pieces)

    def search(left, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not left:
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= left[0]}.values():
            search(left[1:], [*rooms[:k], rooms[k] - left[0], *rooms[k + 1 :]])
        search(left[1:], [*rooms, capacity - left[0]])

    search(sorted(pieces, reverse=True), [])
    return best


def test_plans_against_the_optimum():
    r = random.Random(11)
    for _ in range(120):
        pieces = [r.choice((r.randint(1, 20), r.choice((4, 5, 6, 7)), r.randint(7, 10))) for _ in range(r.randint(1, 11))]
        plan, least = plan_and_bound(np.bincount(pieces, minlength=21), 20)
        got, best = sum(n for _, n in plan), fewest(pieces, 20)
        assert -(-sum(pieces) // 20) <= least <= best <= got <= best + 1


def test_bound_beats_the_size_where_pieces_cannot_fill():
    count = np.zeros(101, int)
    count[60] = 1000  # one to a sequence
    assert plan_and_bound(count, 100)[1] == 1000
    count[34], count[33] = 500, 500  # two and three fit beside nothing but themselves or a 60
    plan, least = plan_and_bound(count, 100)
    assert 980 <= least <= 1000 == sum(n for _, n in plan)


def test_buckets_that_hold_few_pieces(spark):
    rows = [(i % 7, "cat " * (i % 5)) for i in range(400)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORDS, capacity=16, bucket=9).toPandas()
    assert len(got) == 400 and got.least_sequences.nunique() == 1
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()][:-1] and s.length.sum() <= 16
    assert got.least_sequences[0] <= got.sequence_id.nunique() <= got.least_sequences[0] + 1


def test_another_tokenizer_is_used_as_it_is(tmp_path):
    file = tmp_path / "other.json"
    parts = json.loads(open(WORDS).read())
    parts["normalizer"] = None
    file.write_text(json.dumps(parts))
    encoder, other = Encoder(str(file)), Tokenizer.from_file(str(file))
    assert not encoder.by_words and Encoder(WORDS).by_words
    for text in ("The CAT.\nA b", "e\u0301t\u00e9 x"):
        assert encoder.encode(pa.array([text]))[0].tolist() == other.encode(text, add_special_tokens=False).ids


def test_words_of_letters_as_the_library():
    r = random.Random(12)
    letters = "abcXYZ\u00e9\u00df\u00c9e\u0301\u0130\u03a3\u03c2\u0416\u4e2d\u01c5'-.,%4\u00bd\t\u00a0"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(6000)]
    encoder, other = Encoder(WORDS), Tokenizer.from_file(WORDS)
    got = encoder.encode(pa.array([" ".join(words[i : i + 6]) for i in range(0, 6000, 6)]))
    for i, ids in enumerate(got):
        text = " ".join(words[6 * i : 6 * i + 6])
        assert ids.tolist() == other.encode(text, add_special_tokens=False).ids, repr(text)
