"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads the letters of a word and writes its class, and an insult's weight.
Four more read those classes through a clause: negation and reported speech weaken the insults in
their scope, a target strengthens those near it, a threat counts with its target. They are
composed into one machine over the product of their states; a clause's score is the weight of its
path, and a text's score is a logistic function of its clauses' scores. A colon ends no clause,
since reported speech goes on behind it; all apostrophes count alike. Threats, targets, negations
and reports are word lists; insults, as words or stems, and their weights are learned from
labelled rows, as are the numbers of the logistic function.

Training takes at most TRAIN_ROWS labelled rows of each class, chosen by a hash of the id (a
documented bound of the classifier); near copies among them count once. Scoring covers whole texts.

Edge cases. Null, empty and wordless texts have no clause and get the lowest score. No training
row of a class: every score is the share of label 1 known (0 without rows). Repeated rows each
give a row; null doc_id is never a training row and counts as not held out; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskspark.llm.common import least_hashed, map_pieces, share, texts

TRAIN_ROWS = 3000
#: Log-likelihood by which a word or stem must favour label 1 to count as an insult.
EVIDENCE = 11.0
#: Log odds that a word or stem needs, and lengths of stems.
ODDS = 1.5
STEMS = (4, 5, 6, 7, 8)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Word lists (fixed values), in English, German, French and Spanish.
THREATS = frozenset("kill hurt destroy beat punish töten vernichten verletzen schlagen tuer détruire frapper matar destruir golpear".split())
TARGETS = frozenset("you your yours yourself du dich dir dein deine ihr euch tu toi ton ta vous votre tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not never no isn't aren't nicht nie kein keine pas jamais nunca jamás tampoco".split())
REPORTS = frozenset("said says wrote claimed reported quoted sagte schrieb behauptete écrit affirmé dijo escribió afirmó".split())
#: Words that negation reaches, and words between an insult and its target.
SCOPE, REACH = 3, 4

_CLAUSE = regex.compile(r"[.!?;\n]")
_APOSTROPHES = str.maketrans("\u2019\u02bc\u2018\u00b4", "''''")
_WORD = regex.compile(r"[\p{L}\p{M}']+")


@dataclass(frozen=True)
class Transducer:
    """start state and step: (state, symbol) -> (state, symbol, factor, bonus)."""

    start: int
    step: Callable[[int, int], tuple[int, int, float, float]]


def _negation(state: int, symbol: int) -> tuple[int, int, float, float]:
    if symbol == NEGATION:
        return SCOPE, symbol, 1.0, 0.0
    return max(0, state - 1), symbol, 0.6 if state and symbol in (INSULT, THREAT) else 1.0, 0.0


def _report(state: int, symbol: int) -> tuple[int, int, float, float]:
    return int(state or symbol == REPORT), symbol, 0.6 if state and symbol in (INSULT, THREAT) else 1.0, 0.0


def _target(state: int, symbol: int) -> tuple[int, int, float, float]:
    """States 1..REACH: a target was near; -1..-REACH: an insult was."""
    if symbol == TARGET:
        return REACH, symbol, 1.0, 1.0 if state < 0 else 0.0
    if symbol == INSULT:
        return -REACH, symbol, 1.5 if state > 0 else 1.0, 0.0
    return state - (state > 0) + (state < 0), symbol, 1.0, 0.0


def _threat(state: int, symbol: int) -> tuple[int, int, float, float]:
    if symbol == THREAT:
        return REACH, OTHER, 1.0, 0.0
    return (0, symbol, 1.0, 2.0) if symbol == TARGET and state else (max(0, state - 1), symbol, 1.0, 0.0)


def compose(*machines: Transducer) -> Transducer:
    """The machine over the product of the states: each reads what the one before it wrote; factors multiply and bonuses add. The product is built as it is reached."""
    states = {tuple(m.start for m in machines): 0}
    names = list(states)
    arcs: dict[tuple[int, int], tuple[int, int, float, float]] = {}

    def step(state: int, symbol: int) -> tuple[int, int, float, float]:
        if (arc := arcs.get((state, symbol))) is None:
            own, out, factor, bonus = [], symbol, 1.0, 0.0
            for m, s in zip(machines, names[state], strict=True):
                s, out, f, b = m.step(s, out)
                own.append(s)
                factor *= f
                bonus += b
            key = tuple(own)
            if key not in states:
                states[key] = len(names)
                names.append(key)
            arc = arcs[state, symbol] = (states[key], out, factor, bonus)
        return arc

    return Transducer(0, step)


def grammar() -> Transducer:
    zero = lambda f: Transducer(0, f)
    return compose(zero(_negation), zero(_report), zero(_target), zero(_threat))


class Lexical:
    """The transducer from the letters of a word to its class and weight. States are the nodes of a
    tree of all entries; a word entry ends its word, a stem entry needs a further letter."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self.words: dict[int, tuple[int, float]] = {}
        self.stems: dict[int, float] = {}

    def _state(self, letters: str) -> int:
        state = 0
        for x in letters:
            if x not in self.arcs[state]:
                self.arcs[state][x] = len(self.arcs)
                self.arcs.append({})
            state = self.arcs[state][x]
        return state

    def add_word(self, word: str, symbol: int, weight: float = 0.0) -> None:
        self.words[self._state(word)] = (symbol, weight)

    def add_stem(self, stem: str, weight: float) -> None:
        self.stems[self._state(stem)] = weight

    def read(self, word: str) -> tuple[int, float]:
        """(symbol, weight); an insult's weight is the most of its own and its stems'."""
        state, weight = 0, 0.0
        for i, x in enumerate(word):
            state = self.arcs[state].get(x, -1)
            if state < 0:
                break
            if i + 1 < len(word):
                weight = max(weight, self.stems.get(state, 0.0))
        symbol, own = self.words.get(state, (OTHER, 0.0))
        if max(weight, own) > 0:
            return INSULT, max(weight, own)
        return (NEGATION if symbol == OTHER and word.endswith("n't") else symbol), 0.0


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    slopes: tuple[float, float] = (0.0, 0.0)
    offset: float = -20.0


class Scorer:
    def __init__(self, model: Model):
        self.model, self.machine, self.lexical = model, grammar(), Lexical()
        for list_, symbol in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT)):
            for word in list_:
                self.lexical.add_word(word, symbol)
        for word, weight in model.words.items():
            self.lexical.add_word(word, INSULT, weight)
        for stem, weight in model.stems.items():
            self.lexical.add_stem(stem, weight)
        self.cues = ahocorasick.Automaton()
        for word in {*model.words, *model.stems, *THREATS}:
            self.cues.add_word(word, len(word))
        if len(self.cues):
            self.cues.make_automaton()

    def clause(self, words: list[str]) -> float:
        state, total = self.machine.start, 0.0
        for word in words:
            symbol, weight = self.lexical.read(word)
            state, _, factor, bonus = self.machine.step(state, symbol)
            total += weight * factor + bonus
        return total

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the clauses with a score, in code points of the lower-cased text."""
        low, found, end = text.lower().translate(_APOSTROPHES), [], 0
        if not len(self.cues):
            return found
        for last, size in self.cues.iter(low):
            at = last - size + 1
            if at < end or (at and (low[at - 1].isalpha() or low[at - 1] == "'")):
                continue
            # end is past every earlier cue, so the searches for borders read a text once in all
            start = max((m.end() for m in _CLAUSE.finditer(low, end, at)), default=end)
            stop = m.start() if (m := _CLAUSE.search(low, at)) else len(low)
            end = stop
            if score := self.clause(_WORD.findall(low, start, stop)):
                found.append((start, stop, score))
        return found

    def measures(self, text: str) -> tuple[float, float]:
        """The clauses' scores, added, and the same for each hundred words; both as logarithms."""
        total = sum(x[2] for x in self.clauses(text))
        return math.log1p(total), math.log1p(100 * total / (1 + text.count(" ")))

    def score(self, text: str) -> float:
        x = self.model.offset + sum(a * b for a, b in zip(self.model.slopes, self.measures(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _salt(seed: Column) -> Callable[[Column], Column]:
    return lambda word: F.xxhash64(word, seed)


def _stems(size: int) -> Column:
    return F.transform(F.filter("words", lambda x: F.length(x) > size), lambda x: F.concat(F.lit(str(size)), F.substring(x, 1, size)))


#: Words of a shingle, and the rounds in which near copies are looked for, each by some least hashes of a text's shingles.
SHINGLE, ROUNDS, HASHES = 5, 6, 3


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, words) of the training sample: all labelled rows, or as many whole classes of
    hashes as `rows` of each kind hold. Near copies count once: in each round, texts that agree in
    some least hashes of their word shingles are one, so unrelated texts, which share next to no shingle, all stay."""
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = least_hashed(one, "toxic", rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null").select("text", "toxic", F.split(F.lower("text"), r"[^\p{L}\p{M}']+").alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (SHINGLE - 1), F.lit(1)))
    chosen = chosen.withColumn("shingles", F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, SHINGLE))))
    for n in range(ROUNDS):
        least = [F.array_min(F.transform("shingles", _salt(F.lit(seed)))) for seed in range(n * HASHES, (n + 1) * HASHES)]
        first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "words", "shingles")).alias("x")
        chosen = chosen.groupBy("toxic", F.struct(*least).alias("sketch")).agg(first).select("toxic", "x.text", "x.words", "x.shingles")
    return chosen.drop("shingles")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    from maskspark.llm.common import materialize

    sample = materialize(_sample(docs, labels, rows), "toxic-sample")
    held = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    good, bad = held.get(0, 0), held.get(1, 0)
    if not good or not bad:
        return Model(offset=20.0 if bad else -20.0)
    features = F.flatten(F.array(F.transform("words", lambda x: F.concat(F.lit("0"), x)), *map(_stems, STEMS)))
    counted = sample.select("toxic", F.explode(F.array_distinct(features)).alias("f")).groupBy("f").agg(F.sum(F.col("toxic")).alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = (F.col("bad") + 0.5) / (F.col("good") + F.col("bad") + 1)
    gain = F.col("bad") * F.log(odds / (bad / (good + bad))) + F.col("good") * F.log((1 - odds) / (good / (good + bad)))
    best = counted.where(F.length("f") > 3).withColumn("gain", gain).where((F.col("gain") >= EVIDENCE) & ((F.col("bad") + 0.5) / (bad + 1) >= math.exp(ODDS) * (F.col("good") + 0.5) / (good + 1))).collect()  # bounded by the sample: each needs several of its rows
    weight = {r.f: math.log((r.bad + 0.5) / (bad + 1)) - math.log((r.good + 0.5) / (good + 1)) for r in best}
    seen = {r.f: r.bad for r in best}
    model = Model()
    for name in weight:
        (model.words if name[0] == "0" else model.stems)[name[1:]] = weight[name]
    # A stem that owes its evidence to a longer stem or a word goes.
    for name in weight:
        for n in STEMS:
            stem = f"{n}{name[1:][:n]}"
            if len(name) - 1 >= n and stem != name and stem in weight and seen[name] >= 0.8 * seen[stem] and weight[name] >= weight[stem]:
                model.stems.pop(stem[1:], None)
    shared = share(docs.sparkSession, model)

    def make():
        scorer = Scorer(shared())

        def step(piece: pa.RecordBatch) -> dict:
            found = [scorer.measures(t) for t in texts(piece)]
            return {"toxic": piece["toxic"], "x": [v[0] for v in found], "y": [v[1] for v in found]}

        return step

    points = map_pieces(sample.select("text", F.col("toxic").cast("long").alias("toxic")), "text", "toxic long, x double, y double", make).toArrow()  # at most 2 * rows
    *slopes, model.offset = _logistic(np.stack([points["x"].to_numpy(), points["y"].to_numpy()], 1), points["toxic"].to_numpy())
    model.slopes = tuple(slopes)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Slopes and offset by Newton's method with a weak prior, which keeps separable data finite."""
    x = np.column_stack([x, np.ones(len(x))])
    prior = np.array([1e-2] * (x.shape[1] - 1) + [1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(prior), x.T @ (p - y) + prior * w)
        w = w - step
        if abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: Model, held_out: str = "false") -> DataFrame:
    """doc_id, held_out (an SQL condition), score, predicted of every row of docs."""
    shared = share(docs.sparkSession, model)  # what the bounded sample holds

    def make():
        scorer = Scorer(shared())

        def step(piece: pa.RecordBatch) -> dict:
            scores = [scorer.score(t) for t in texts(piece)]
            return {"doc_id": piece["doc_id"], "held_out": piece["held_out"], "score": scores, "predicted": [int(s >= 0.7) for s in scores]}

        return step

    return map_pieces(docs.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out")), "text", "doc_id long, held_out boolean, score double, predicted int", make)
