"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes and identifier
cues. A deterministic parser for each kind expands an anchor to both sides and validates the
boundaries. Four base kinds have fixed definitions (email, ip, card, phone); the anchors of
schemes and cues add `userinfo` (credentials in a URL's authority) and `account` (an IBAN with
right check digits, or 6 or more digits behind a cue word).

Edge cases. Null text counts as empty: no spans. Whole texts are scanned, of any length, in time
linear in the text but for a digit run under several anchors, which is parsed once. Offsets are
code points, end exclusive. Repeated rows each give a row; null doc_id is kept; extra columns are
kept by `redact` and ignored by `find_personal_data`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from maskspark.llm.common import map_pieces, texts

#: Order of kinds in reports (fixed values: the base kinds, then the added ones).
KINDS = ("email", "ip", "card", "phone", "account", "userinfo")
#: Words that announce an account or identity number (fixed values).
CUES = ("iban", "account no", "account number", "kontonummer", "konto-nr", "numéro de compte", "número de cuenta", "passport", "reisepass", "passeport", "pasaporte", "ssn")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_NUMBER = re.compile(r"[:#=\x20.]{0,4}([0-9](?:[\x20-]?[0-9]){5,33})(?![0-9A-Za-z])")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[^\s@/?#]+(?=@[A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, m: re.Match) -> int | None:
    """Where the IBAN at the start of the match ends: the last end of a group up to which the check holds, since words in capitals may follow."""
    ends = [m.end(), *(i for i in range(m.end() - 1, m.start(), -1) if text[i] == " ")]
    return next((e for e in ends if not _ALNUM.match(text, e) and iban_ok(text[m.start() : e])), None)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper(), cue.title()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign; floor is the end of the match before it."""
    start = at
    while start > floor and text[start - 1] in _LOCAL_CHARS:
        start -= 1
    if start == at or not (m := _DOMAIN.match(text, at + 1)):
        return None
    return start, m.end()


def _quads(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """Every four dotted numbers of the run at start, and the run's end."""
    m = _QUADS.match(text, start)
    found, at, parts = [], start, m[0].split(".")
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        size = sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
            found.append((at, at + size))
        at += size + 1
    return found, m.end()


def spans(text: str, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start and then in the order of KINDS."""
    found: list[tuple[str, int, int]] = []
    mail_end = quad_end = group_end = dial_end = account_end = 0
    for last, (anchor, size) in machine.iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at >= quad_end:
                quads, quad_end = _quads(text, at)
                found += [("ip", *q) for q in quads]
            if at >= group_end:
                m = _GROUPED.match(text, at)
                group_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", at, group_end))
        elif anchor == "at":
            if at >= mail_end and (hit := _email(text, at, mail_end)):
                found.append(("email", *hit))
                mail_end = hit[1]
        elif anchor == "plus":
            if at >= dial_end and (m := _DIALLED.match(text, at)):
                end = m.end()
                while not text[end - 1].isdigit():
                    end -= 1
                if end - at >= 4:  # a plus, a digit, one character at least, a digit
                    dial_end = end
                    if 10 <= sum(c.isdigit() for c in text[at:end]) <= 15:
                        found.append(("phone", at, end))
        elif anchor == "scheme":
            if m := _USERINFO.match(text, last + 1):
                found.append(("userinfo", m.start(), m.end()))
        elif last + 1 >= account_end:
            if (m := _IBAN.search(text, last + 1, min(len(text), last + 48))) and m.start() <= last + 6 and (end := iban_end(text, m)):
                found.append(("account", m.start(), end))
                account_end = end
            elif m := _NUMBER.match(text, last + 1):
                found.append(("account", m.start(1), m.end(1)))
                account_end = m.end()
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return found


def render(items: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in items)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs."""

    def make():
        machine = automaton()
        base = KINDS[:4]

        def step(piece: pa.RecordBatch) -> dict:
            out = {"doc_id": piece["doc_id"], **{f"n_{k}": [] for k in base}, "base_sha256": [], "spans": []}
            for text in texts(piece):
                all_ = spans(text, machine)
                own = [s for s in all_ if s[0] in base]
                for k in base:
                    out[f"n_{k}"].append(sum(s[0] == k for s in own))
                out["base_sha256"].append(hashlib.sha256(render(own).encode()).hexdigest())
                out["spans"].append(render(all_))
            return out

        return step

    return map_pieces(docs.select("doc_id", "text"), "text", "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def mask(text: str, items: list[tuple[str, int, int]]) -> str:
    """text with each span (overlapping ones joined, named by the first) as its kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(items):
        kind, a, b = items[i]
        while i + 1 < len(items) and items[i + 1][1] < b:
            i += 1
            b = max(b, items[i][2])
        out += [text[at:a], f"[{kind.upper()}]"]
        at, i = b, i + 1
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with personal data in text masked; null text stays null."""
    from maskspark.llm.common import _arrow_schema, forget, pieces

    schema = docs.schema
    arrow = _arrow_schema(docs.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))

    def run(batches):
        forget()
        machine = automaton()
        at = arrow.get_field_index("text")
        for batch in batches:
            for piece in pieces(batch, "text"):
                new = pa.array([None if t is None else mask(t, spans(t, machine)) for t in piece["text"].to_pylist()], arrow.field(at).type)
                columns = [new if i == at else c.cast(arrow.field(i).type) for i, c in enumerate(piece.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, schema)
