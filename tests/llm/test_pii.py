import hashlib
import random
import re

import pytest

from maskspark.llm.pii import automaton, find_personal_data, iban_ok, luhn, mask, redact, spans

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def brute(text):
    out = [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text) if ok(m[0])]
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_against_patterns():
    machine = automaton()
    r = random.Random(5)
    bits = ["a", "b.c", "@", ".", "-", " ", "+", "1", "12", "255", "256", "4041894974608795", "(", ")", "1.2.3.4", "a@b.co", "é", "+1 (988) 555-2485", "0", "\n", "%", "٣", "_"]
    for _ in range(20000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert [s for s in spans(text, machine) if s[0] in BASE] == brute(text), text


def test_added_kinds_and_masking():
    machine = automaton()
    text = "IBAN DE89 3704 0044 0532 0130 00 and https://me:pw@host.org/ x@y.org."
    got = spans(text, machine)
    assert iban_ok("DE89370400440532013000") and not iban_ok("DE89370400440532013001")
    assert [text[a:b] for k, a, b in got if k == "account"] == ["DE89 3704 0044 0532 0130 00"]
    assert [text[a:b] for k, a, b in got if k == "userinfo"] == ["me:pw"]
    assert mask("to x@y.org.", spans("to x@y.org.", machine)) == "to [EMAIL]."


@pytest.mark.parametrize("after", [" BIC: COBADEFF", " COBADEFF", " BIC COBADEFFXXX OR MORE", " A B C D", ""])
def test_iban_before_words_in_capitals(after):
    text = "IBAN DE89 3704 0044 0532 0130 00" + after
    assert mask(text, spans(text, automaton())) == "IBAN [ACCOUNT]" + after
    text = "IBAN: DE89370400440532013000" + after
    assert mask(text, spans(text, automaton())) == "IBAN: [ACCOUNT]" + after


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "q@w.de", "c"), (3, "n" * 100000 + " q@w.de", "d"), (3, "n" * 100000 + " q@w.de", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_email, r.spans) for r in find_personal_data(df).collect()}
    assert got == {(1, 0, ""), (2, 0, ""), (None, 1, "email:0:6"), (3, 1, "email:100001:100007")}
    assert find_personal_data(df).where("doc_id = 1").first().base_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.spans, (r.text or "")[-8:]) for r in redact(df).collect())[:2] == [(0, "c", "[EMAIL]"), (1, "a", "")]
    assert redact(df).schema == df.schema
    assert find_personal_data(df.limit(0)).collect() == []
