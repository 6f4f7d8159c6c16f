import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskspark.llm import language, toxicity
from maskspark.llm.common import least_hashed, remainder
from maskspark.llm.language import Model, viterbi

SF = "/root/testdata/sf0.1"


def best_path(scores):
    import itertools

    return max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: sum(scores[t, k] for t, k in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False)))


def test_viterbi_against_all_paths():
    r = np.random.default_rng(1)
    for _ in range(40):
        s = r.normal(0, 12, (6, 2, 3)).astype(np.float32)
        got = viterbi(s)
        assert [tuple(got[:, k].tolist()) for k in (0, 1)] == [best_path(s[:, k]) for k in (0, 1)]


def test_language_of_mixed_text(spark):
    r = random.Random(1)
    words = {"en": "the and with from have house water".split(), "ru": "это вода дом быть между человек".split(), "de": "und nicht schön größe wasser mit".split()}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(30)), x) for i in range(300) for x in [("en", "ru", "de")[i % 3]]] + [(900, None, "en"), (901, "123 !", None), (None, "the water", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == ["de", "en", "ru"]
    got = {x.doc_id: (x.lang_pred, x.score) for x in language.identify(docs, model).collect()}
    assert all(got[i][0] == x for i, _, x in rows[:300]) and got[900] == ("und", 0.0) and got[901] == ("und", 0.0)
    mixed = "the house with water from " * 3 + "это вода между человек " * 3
    w = language.words_of([mixed])
    spans = [model.languages[k] for k in model.spans(model.word_scores(w))]
    assert spans == ["en"] * 15 + ["ru"] * 12
    assert language.identify(docs, language.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert language.identify(docs.limit(0), model).collect() == []
    kept = language.recognised(docs.withColumn("score", F.lit("x")), model, 0.5)
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == 301
    assert Model([], np.zeros((2, 0)), np.zeros((1, 0), bool)).predict(["a"]) == [("und", 0.0)]


def test_grammar():
    scorer = toxicity.Scorer(toxicity.Model(words={"idiot": 2.0}, stems={"moro": 1.0}, slopes=(1.0, 0.0), offset=-1))
    one = lambda t: sum(x[2] for x in scorer.clauses(t))
    assert one("nothing here.") == 0 and one("an idiot.") == 2
    assert one("you idiot") > one("an idiot") > one("never an idiot")
    assert one("he said an idiot came") < one("an idiot came")
    assert one("I will kill you") > 0 and one("to kill time") == 0
    assert one("idiots") == 0 and one("preidiot") == 0
    assert len(scorer.clauses("an idiot. fine words. an idiot again")) == 2
    assert toxicity.Scorer(toxicity.Model()).score("") < 0.01


def test_long_clause_is_read_from_its_start():
    scorer = toxicity.Scorer(toxicity.Model(words={"idiot": 2.0}, slopes=(1.0, 0.0), offset=-1))
    text = "fine. he said " + "word " * 600 + "an idiot came. you idiot"
    (start, _, score), (_, _, other) = scorer.clauses(text)
    assert start == 5 and score == scorer.clauses("he said an idiot came")[0][2]
    assert other == scorer.clauses("you idiot")[0][2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test relations")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").where(remainder("doc_id", 3) == 1)
    model = toxicity.train(docs.where(remainder("doc_id", 3) != 1), labels)
    got = toxicity.score(held, model).join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n.get((1, 1), 0) >= 0.9 * (n.get((1, 0), 0) + n.get((1, 1), 0))
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0]
    out = docs.where(remainder("doc_id", 4) == 2)
    found = language.identify(out, language.train(docs.where(remainder("doc_id", 4) != 2))).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()


def test_toxicity_without_training(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None), (None, "y")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0, 0]
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_reports_go_on_behind_a_colon_and_apostrophes_count_alike():
    scorer = toxicity.Scorer(toxicity.Model(words={"idiot": 2.0}, slopes=(1.0, 0.0), offset=-1))
    one = lambda t: sum(x[2] for x in scorer.clauses(t))
    assert one("he said: you idiot") == one("he said you idiot") < one("you idiot")
    assert one("he isn\u2019t an idiot") == one("he isn't an idiot") == one("he couldn't be an idiot") < one("he is an idiot")


def by_hand(words, insults):
    """The clause's score by the grammar's rules, without machines."""
    total, report, negated, target, insult, threat = 0.0, False, 0, 0, 0, 0
    for w in words:
        kind = "insult" if w in insults else next((k for k, v in (("threat", toxicity.THREATS), ("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS)) if w in v), "")
        factor, bonus = 1.0, 0.0
        if kind in ("insult", "threat"):
            factor *= (0.6 if negated else 1) * (0.6 if report else 1)
        if kind == "insult":
            factor *= 1.5 if target else 1
            target, insult = 0, toxicity.REACH
        elif kind == "target":
            bonus += (1.0 if insult else 0.0) + (2.0 if threat else 0.0)
            target, insult = toxicity.REACH, 0
        else:
            target, insult = max(0, target - 1), max(0, insult - 1)
        threat = toxicity.REACH if kind == "threat" else 0 if kind == "target" else max(0, threat - 1)
        negated = toxicity.SCOPE if kind == "negation" else max(0, negated - 1)
        report = report or kind == "report"
        total += (insults[w] * factor if kind == "insult" else 0.0) + bonus
    return total


def test_grammar_against_rules_by_hand():
    insults = {"idiot": 2.0, "moron": 1.25}
    scorer = toxicity.Scorer(toxicity.Model(words=insults, slopes=(1.0, 0.0), offset=-1))
    r = random.Random(6)
    for _ in range(3000):
        words = [r.choice(["idiot", "moron", "kill", "you", "never", "said", "stone", "river"]) for _ in range(r.randint(1, 12))]
        assert scorer.clause(words) == pytest.approx(by_hand(words, insults)), words


def test_marks_are_no_letters_and_scripts_are_ranges():
    size = lambda t: language.words_of([t]).size.tolist()
    assert size("\u201chello\u201d") == [5] and size("a\u2014b") == [1, 1] and size("a\u00a0b") == [1, 1] and size("e\u0301t\u00e9") == [4]
    script = lambda t: [language.SCRIPTS[k - 1][0] if k else "" for k in language.words_of([t]).script]
    assert script("the \u0e01\u0e02 \u0915\u0916 \u304b\u306a \u6f22\u5b57 \ud55c\uae00 \u0561\u0562 \u0431\u0432 \u1ea1") == ["latin", "thai", "devanagari", "kana", "han", "hangul", "armenian", "cyrillic", "latin"]


def test_samples_are_bounded_and_the_same_each_time(spark):
    rows = [(i, "ab"[i % 10 == 0], f"text {i}") for i in range(4000)] + [(5000, "c", "x")] * 30 + [(None, "a", "x"), (1, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    got = [sorted(r.doc_id for r in least_hashed(df, "lang", 100).collect()) for _ in range(2)]
    kinds = {i: "ab"[i % 10 == 0] for i in range(4000)}
    assert got[0] == got[1] and set(got[0]) - set(kinds) <= {5000}
    for kind in "ab":
        assert 85 <= sum(kinds.get(i) == kind for i in got[0]) <= 100
    assert [r.doc_id for r in least_hashed(df, "lang", 30).where("lang = 'c'").collect()] == [5000] * 30
    assert least_hashed(df, "lang", 29).where("lang = 'c'").count() == 0
    assert least_hashed(df.limit(0), "lang", 5).collect() == []


def test_learned_rows_repeat_and_clash(spark):
    rows = [(1, "the house and the water", "en", "x")] * 3 + [(2, "und nicht sch\u00f6n", "de", "x"), (2, "und nicht sch\u00f6n", "de", "x"), (3, "the water " * 100_000, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumnRenamed("score", "lang_pred")
    got = language.identify(docs, language.train(docs)).collect()
    found = {(r.doc_id, r.lang_pred, r.score) for r in got}
    assert len(got) == 6 and len(found) == 3 and {(2, "de"), (3, "en")} <= {x[:2] for x in found}
    clash = docs.withColumnRenamed("lang_pred", "predicted").withColumn("toxic", F.lit(9))
    scored = toxicity.score(clash, toxicity.train(clash, spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, toxic int"))).collect()
    assert len(scored) == 6 and len({(r.doc_id, r.score) for r in scored}) == 3


def test_any_number_of_languages(spark):
    """Beyond LANGUAGES, models fold their trigrams and still tell the languages apart."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300 * 8)]
    rows = [(d * 1000 + i, " ".join(r.choice(words[8 * i : 8 * i + 8]) for _ in range(30)), f"l{i:03}") for i in range(300) for d in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.languages) == 300 and model.scores.shape == (1 << (language.FEATURE_BITS - 1), 300)
    right = language.identify(docs, model).join(docs, "doc_id").where("lang_pred = lang").count()
    assert right >= 0.95 * len(rows)


def test_unknown_scripts_are_not_recognised(spark):
    rows = [(1, "the house and the water " * 5, "en"), (2, "это вода и дом " * 5, "ru"), (3, "漢字の文章 " * 20, "xx"), (4, "the house 漢字漢字", "xx"), (5, "the house and water 漢", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("lang <> 'xx'"))
    assert sorted(r.doc_id for r in language.recognised(docs, model, 0.7).collect()) == [1, 2, 5]
    assert all(r.lang_pred in ("en", "ru") for r in language.identify(docs, model).collect())


def test_training_keeps_unrelated_rows(spark):
    """Texts that share words, even a rare one, all stay; near copies count once."""
    r = random.Random(7)
    pool = [f"{a}{b}word" for a in "bcdfghjklm" for b in "aeiou"] + ["extraordinary"]
    text = lambda: " ".join(r.choice(pool) for _ in range(60)) + " extraordinary"
    rows = [(i, text()) for i in range(300)]
    base = text().split()
    rows += [(1000 + i, " ".join([*base[:-1], f"last{i}"])) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows[:300]] + [(1000 + i, 1) for i in range(50)], "doc_id long, toxic int")
    kept = toxicity._sample(docs, labels, 3000).collect()
    texts = {x.text for x in kept}
    assert {t for _, t in rows[:300]} <= texts and len(texts) <= 310
