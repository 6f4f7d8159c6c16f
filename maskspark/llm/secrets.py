"""Secret scans with multipart credential linking; DataFrame functions only.

Base spans have fixed definitions (assign, access, hex). The method looks for parts of
credentials that mean little alone: `key` (40 characters of base64 that mix cases and digits)
and `endpoint` (a host behind a scheme). Parts and access identifiers are interval-joined within
a scope (a window of REACH code points): a `key` is reported only where an access identifier
lies within reach, an `endpoint` only where an access identifier and a key or an assignment do.

Positions come from one lazy pattern for each kind, whose matches are the gap before a match and
the match: their lengths, summed, are the offsets. Scopes lie within one text, so the join runs
inside its row. Both sides are sorted by place, and spans of one kind do not overlap, so each weak
part looks up by halving the one access identifier that can be in its scope.

Edge cases. Null counts as empty text: no spans. Whole texts are scanned, of any length. Offsets
are code points, end exclusive. Repeated rows each give a row; null doc_id is kept; extra columns
are ignored; an empty table gives an empty result. Overlapping spans of several kinds all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskspark.llm.common import let

#: Code points between two parts of one credential.
REACH = 240

#: Patterns (fixed values of the base kinds, then the method's).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Runs are maximal, so asking for their least length in the pattern finds the same runs.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY = r"[A-Za-z0-9/+]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"
KINDS = ("assign", "access", "hex", "key", "endpoint")
BASE = KINDS[:3]
_SPANS = "array<struct<s:int,e:int,m:string>>"


def matches(text: Column, pattern: str, hint: str) -> Column:
    """The leftmost non-overlapping matches of pattern: array of (s, e, m). hint: a pattern without which there is none."""
    whole = F.lit(rf"\G(?s)(.*?)({pattern})")
    cut = lambda t: F.zip_with(
        F.regexp_extract_all(t, whole, F.lit(1)),
        F.regexp_extract_all(t, whole, F.lit(0)),
        lambda gap, both: F.struct(F.length(gap).alias("gap"), F.length(both).alias("both"), F.substring(both, F.length(gap) + 1, F.length(both)).alias("m")),
    )
    return let(F.when(text.rlike(hint), text).otherwise(""), lambda t: _placed(cut(t)))


def _placed(parts: Column) -> Column:
    """Lengths summed to offsets. Chunks of about the square root of all matches are summed apart,
    then the chunks' ends, so that no array of all matches is copied for each match."""
    one = lambda chunk: F.aggregate(
        chunk,
        F.struct(F.lit(0).alias("end"), F.array().cast(_SPANS).alias("all")),
        lambda a, x: F.struct(
            (a["end"] + x["both"]).alias("end"),
            F.concat(a["all"], F.array(F.struct((a["end"] + x["gap"]).alias("s"), (a["end"] + x["both"]).alias("e"), x["m"].alias("m")))).alias("all"),
        ),
    )
    starts = lambda chunks: F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("all")),
        lambda a, c: F.struct((a["end"] + c["end"]).alias("end"), F.concat(a["all"], F.array(a["end"])).alias("all")),
        lambda a: a["all"],
    )
    moved = lambda c, start: F.transform(c["all"], lambda x: F.struct((x["s"] + start).alias("s"), (x["e"] + start).alias("e"), x["m"].alias("m")))

    def chunked(all_: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_))).cast("int")
        cut = F.transform(F.sequence(F.lit(1), F.size(all_), width), lambda i: one(F.slice(all_, i, width)))
        return let(cut, lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), moved)))

    return let(parts, lambda p: F.when(F.size(p) <= 16, one(p)["all"]).otherwise(chunked(p)))


def _near(part: Column, others: Column) -> Column:
    """Whether one of others lies within reach of part. They are sorted and apart from each other,
    so only the last one that begins before part's scope ends can: found by halving."""
    n = F.size(others)

    def half(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        before = F.coalesce(F.get(others, mid)["s"] <= part["e"] + REACH, F.lit(False))
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & before, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~before, mid).otherwise(a["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    count = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), half, lambda a: a["lo"])
    return F.coalesce(F.get(others, count - 1)["e"] + REACH >= part["s"], F.lit(False))


def with_parts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as doc_id and the spans of each kind; weak parts only where they are linked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        "doc_id",
        F.filter(matches(text, ASSIGN, r"(?i)passw|secret|token|api_?key"), lambda x: F.length(F.regexp_extract(x["m"], VALUE, 1)) >= 6).alias("assign"),
        matches(text, ACCESS, "AKIA").alias("access"),
        matches(text, HEX, HEX).alias("hex"),
        F.when(text.contains("AKIA"), F.filter(matches(text, KEY, KEY), lambda x: x["m"].rlike("[a-z]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[0-9]") & ~x["m"].startswith("AKIA"))).otherwise(F.array().cast(_SPANS)).alias("key"),
        F.when(text.contains("AKIA"), matches(text, ENDPOINT, "https?://")).otherwise(F.array().cast(_SPANS)).alias("endpoint"),
    )
    df = df.withColumn("key", F.filter("key", lambda k: _near(k, F.col("access"))))
    return df.withColumn("endpoint", F.filter("endpoint", lambda x: _near(x, F.col("access")) & (_near(x, F.col("key")) | _near(x, F.col("assign")))))


def _shown(kinds: tuple[str, ...]) -> Column:
    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k")))

    return F.array_join(F.transform(F.sort_array(F.flatten(F.array(*map(named, kinds)))), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs."""
    return with_parts(docs).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_shown(BASE), 256).alias("base_sha256"),
        _shown(KINDS).alias("spans"),
    )
