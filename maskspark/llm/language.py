"""Language identification of mixed texts.

Words are runs of letters and the marks on them. The script of a word (the range of code points of
its first letter) narrows the candidates to languages that use it; hashed trigrams of code points
give each word a score for each language; Viterbi over the words with a penalty for each switch
labels spans. A text's language is the one whose spans hold most letters; its score is that share.

Training takes, for each language, at most TRAIN_DOCS documents of the given rows, chosen by a
hash of the id (a documented bound of the classifier); everything else covers whole texts.

Edge cases. Null text or no letter: `und`, score 0. No training row: `und` for every text. Ties:
the first language in alphabetical order. Any number of languages: beyond LANGUAGES, each doubling
halves the number of hashed trigrams that a language has scores for, so a model stays below 2^25 scores.
Repeated rows each give a row and each count in training; null doc_id is never a training row but is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.llm.common import least_hashed, map_pieces, per_process, share

TRAIN_DOCS = 1500
FEATURE_BITS = 17
#: Bytes of text scored at once; each needs some fifty bytes of scores.
PIECE = 1 << 20
#: Nats that a switch of language costs: more than one odd word can pay.
SWITCH = 12.0
#: Nats taken from a language that does not use a word's script.
FOREIGN = 20.0
#: Least share of a language's letters for it to use a script.
USES = 0.01

#: Languages for which a model keeps all FEATURE_BITS of its trigrams: half a megabyte each.
LANGUAGES = 256
#: Words whose scores are added at once.
WORDS_AT_ONCE = 1 << 12

_LETTER = regex.compile(r"\p{L}")
#: Scripts by ranges of code points (fixed values); letters outside them have script 0, which every language may use.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F))),
    ("armenian", ((0x531, 0x58F),)),
    ("hebrew", ((0x5D0, 0x5F4),)),
    ("arabic", ((0x620, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)),
    ("gujarati", ((0xA80, 0xAFF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)),
    ("malayalam", ((0xD00, 0xD7F),)),
    ("sinhala", ((0xD80, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("lao", ((0xE80, 0xEFF),)),
    ("tibetan", ((0xF00, 0xFFF),)),
    ("burmese", ((0x1000, 0x109F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("ethiopic", ((0x1200, 0x139F),)),
    ("khmer", ((0x1780, 0x17FF),)),
    ("kana", ((0x3041, 0x30FF), (0xFF66, 0xFF9D))),
    ("han", ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)


def _letters_and_scripts() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter or a mark, and its script."""
    kinds = (unicodedata.category(chr(c))[0] for c in range(0x110000))
    letter = np.fromiter((k in "LM" for k in kinds), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for i, (_, ranges) in enumerate(SCRIPTS):
        for first, last in ranges:
            script[first : last + 1] = i + 1
    return letter, script


@dataclass
class Words:
    """The words of several texts: code of every trigram, and for each word its first trigram, script, size in code points and text."""

    codes: np.ndarray
    first: np.ndarray
    script: np.ndarray
    size: np.ndarray
    text: np.ndarray


def words_of(texts: list[str]) -> Words:
    is_letter, scripts = per_process("language", _letters_and_scripts)
    low = [t.lower() for t in texts]
    data = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter[data]
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    at = np.flatnonzero(letter)
    w = np.where(letter, data, np.uint32(0x20))
    mixed = (w[at - 1] * np.uint32(0x9E3779B1) ^ w[at] * np.uint32(0x85EBCA77) ^ w[at + 1] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    codes = (mixed >> np.uint32(32 - FEATURE_BITS)).astype(np.int64)
    size = end - start
    first = np.cumsum(size) - size
    ends = np.cumsum(np.array([len(t) + 1 for t in low], np.int64))
    return Words(codes, first, scripts[data[start]], size, np.searchsorted(ends, start, side="right"))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # [features, languages]
    uses: np.ndarray  # [scripts, languages]

    def word_scores(self, words: Words) -> np.ndarray:
        if not len(words.first):
            return np.zeros((0, len(self.languages)), np.float32)
        codes = words.codes >> (FEATURE_BITS + 1 - len(self.scores).bit_length())
        s = np.empty((len(words.first), len(self.languages)), np.float32)
        ends = np.append(words.first[1:], len(codes))
        for a in range(0, len(s), WORDS_AT_ONCE):
            mine = words.first[a : a + WORDS_AT_ONCE]
            s[a : a + WORDS_AT_ONCE] = np.add.reduceat(self.scores[codes[mine[0] : ends[a + len(mine) - 1]]], mine - mine[0], axis=0)
        known = self.uses[words.script]
        return s - np.where(known.any(1, keepdims=True) & ~known, FOREIGN, 0).astype(np.float32)

    def spans(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word of one text."""
        return viterbi(scores[:, None, :])[:, 0]

    def predict(self, texts: list[str | None], known: bool = False) -> list[tuple[str, float]]:
        """(language, share of the letters in its spans) of each text; known: letters of scripts that no language uses are in no span."""
        out = [("und", 0.0)] * len(texts)
        voiced = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        words = words_of([texts[i] for i in voiced])
        scores = self.word_scores(words)
        counted = words.size * self.uses[words.script].any(1) if known and len(words.size) else words.size
        held = np.bincount(words.text, minlength=len(voiced))
        begin = np.cumsum(held) - held
        order, at = np.argsort(-held, kind="stable"), 0
        while at < len(order):
            longest = max(1, held[order[at]])
            group = order[at : at + max(1, min(512, (1 << 19) // longest))]
            at += len(group)
            grid = np.zeros((longest, len(group), len(self.languages)), np.float32)
            size, mine = np.zeros((longest, len(group)), np.int64), np.zeros((longest, len(group)), np.int64)
            for k, d in enumerate(group):
                grid[: held[d], k] = scores[begin[d] : begin[d] + held[d]]
                size[: held[d], k] = words.size[begin[d] : begin[d] + held[d]]
                mine[: held[d], k] = counted[begin[d] : begin[d] + held[d]]
            label = viterbi(grid)
            shares = np.stack([(mine * (label == k)).sum(0) for k in range(len(self.languages))], 1)
            total = size.sum(0)
            best = np.where(total > 0, shares.argmax(1), grid.sum(0).argmax(1))
            for k, d in enumerate(group):
                out[voiced[d]] = (self.languages[best[k]], float(shares[k, best[k]] / total[k]) if total[k] else 0.0)
        return out


def viterbi(scores: np.ndarray) -> np.ndarray:
    """Best labels [time, text] for scores [time, text, label]; a switch costs SWITCH."""
    steps, texts, _ = scores.shape
    stays, best = np.empty(scores.shape, bool), np.empty((steps, texts), np.int64)
    v = scores[0].copy()
    row = np.arange(texts)
    for t in range(1, steps):
        best[t] = v.argmax(1)
        switched = v[row, best[t]][:, None] - SWITCH
        stays[t] = v >= switched
        v = np.where(stays[t], v, switched) + scores[t]
    label = np.empty((steps, texts), np.int64)
    state = v.argmax(1)
    for t in range(steps - 1, -1, -1):
        label[t] = state
        if t:
            state = np.where(stays[t][row, state], state, best[t])
    return label


def train(rows: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """A model from rows (doc_id, text, lang); null languages are left out."""
    sample = least_hashed(rows.where("text is not null").select("doc_id", "lang", "text"), "lang", per_language).select("lang", "text").repartition(6, F.xxhash64("text"))

    def make():
        def step(piece: pa.RecordBatch) -> dict:
            out = {"lang": [], "counts": [], "scripts": []}
            langs, texts = piece["lang"].to_pylist(), piece["text"].to_pylist()
            for lang in sorted(set(langs)):
                words = words_of([t for t, x in zip(texts, langs, strict=True) if x == lang])
                counts = np.bincount(words.codes, minlength=1 << FEATURE_BITS)
                used = np.flatnonzero(counts)
                out["lang"].append(lang)
                out["counts"].append(np.concatenate([used, counts[used]]).astype(np.int32).tobytes())
                out["scripts"].append(np.bincount(words.script, weights=words.size, minlength=len(SCRIPTS) + 1).astype(np.int64).tobytes())
            return out

        return step

    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    folds = 0
    for r in map_pieces(sample, "text", "lang string, counts binary, scripts binary", make, PIECE).toLocalIterator():
        used, n = np.frombuffer(r.counts, np.int32).reshape(2, -1)
        np.add.at(counts.setdefault(r.lang, np.zeros(1 << (FEATURE_BITS - folds), np.float32)), used >> folds, n)
        scripts[r.lang] = scripts.get(r.lang, 0) + np.frombuffer(r.scripts, np.int64)
        if len(counts) > LANGUAGES << folds:
            folds += 1
            counts = {lang: c.reshape(-1, 2).sum(1) for lang, c in counts.items()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << FEATURE_BITS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    c = np.stack([counts[x] for x in languages], 1)
    seen = max(1, int((c.sum(1) > 0).sum()))
    p = np.log((c + 0.5) / (c.sum(0) + 0.5 * seen))
    p = np.clip(p - p.mean(1, keepdims=True), -4, 4)
    p[c.sum(1) == 0] = 0
    s = np.stack([scripts[x] for x in languages], 1).astype(float)
    uses = s >= USES * np.maximum(1, s.sum(0))
    uses[0] = True
    return Model(languages, p.astype(np.float32), uses)


def piece_bytes(model: Model) -> int:
    """Text that is scored at once: less for many languages, as each word has a score for each."""
    return max(1 << 13, PIECE * 8 // max(8, len(model.languages)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text)."""
    shared = share(docs.sparkSession, model)  # 2^25 scores of four bytes at most

    def make():
        model = shared()

        def step(piece: pa.RecordBatch) -> dict:
            found = model.predict(piece["text"].to_pylist())
            return {"doc_id": piece["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return step

    return map_pieces(docs.select("doc_id", "text"), "text", "doc_id long, lang_pred string, score double", make, piece_bytes(model))


def recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns, with a language of score at least `least`. Letters of a script that no learned language uses count against every language."""
    shared, limit = share(docs.sparkSession, model), piece_bytes(model)

    def run(batches):
        from maskspark.llm.common import forget, pieces

        forget()
        model = shared()
        for batch in batches:
            for piece in pieces(batch, "text", limit):
                keep = [lang != "und" and score >= least for lang, score in model.predict(piece["text"].to_pylist(), known=True)]
                yield piece.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
