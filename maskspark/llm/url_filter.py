"""URL filters: rules by host and path, and a classifier over segmented names for the rest.

Concatenated host names are split into words by unigram Viterbi: the words' counts come from the
pages' own text, and only substrings of host names are ever looked up, so the vocabulary that
reaches one name is bounded by its length. Multinomial naive Bayes then scores the words of host
and path; it learns from the URLs that a rule decides. Everything runs over distinct hosts and
paths, counted before the first shuffle by host, so a hot host is one row.

Edge cases. Null URL or one without `://`: host and path empty, no tokens, so the prior decides.
A host's port and user stay part of it. Case matters in paths. Without decided URLs, or with
those of one verdict only, the rest is allowed, as are ties. Null html adds no words. Repeated
rows each give a row and each count; null page_id is kept; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskspark.llm.common import materialize

#: Rules (host, path, verdict) of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Longest word of a host name, and the count that an unknown letter has among all words.
LONGEST_WORD, UNKNOWN = 20, 0.01
#: Laplace's addition to every token's count.
SMOOTHING = 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null without one."""
    fitting = None
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fitting = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitting if fitting is not None else F.lit(None))
    return fitting


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, count) over the visible text of all pages."""
    text = F.lower(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " "))
    return pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def viterbi_split(name: str, counts: dict[str, int], total: float) -> list[str]:
    """The likeliest split of name; letters of unknown words stand alone, or stay together when the whole is unknown."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    log_total = math.log(total + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            word = name[start:end]
            n = counts.get(word, 0)
            cost = math.log(n) - log_total if n else (math.log(UNKNOWN) - log_total) * (end - start)
            if best[start] + cost > best[end]:
                best[end], back[end] = best[start] + cost, start
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for distinct names."""
    n = F.length("name")
    sub = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), n - i + 1)), lambda k: F.substring(F.col("name"), i, k))))
    total = float(counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    looked = names.where(n > 0).select("name", F.explode(F.array_distinct(sub)).alias("word")).join(counts, "word", "left")
    held = looked.groupBy("name").agg(F.collect_list(F.when(F.col("count").isNotNull(), F.struct("word", "count"))).alias("known"))  # at most LONGEST_WORD * length entries

    def run(batches):
        for batch in batches:
            names, known = batch["name"].to_pylist(), batch["known"].to_pylist()
            words = [viterbi_split(name, {x["word"]: x["count"] for x in k}, total) for name, k in zip(names, known, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return held.mapInArrow(run, "name string, words array<string>")


def naive_bayes(tokens: DataFrame) -> DataFrame:
    """(token, weight): log P(token | block) - log P(token | allow), from (token, verdict, count)."""
    sums = tokens.groupBy("token").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("count")).otherwise(0)).alias(v) for v in ("block", "allow")))
    all_ = sums.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("b"), F.coalesce(F.sum("allow"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("v")).first()
    chance = lambda c, n: F.log((F.col(c) + SMOOTHING) / (float(n) + SMOOTHING * max(1, all_.v)))
    return sums.select("token", (chance("block", all_.b) - chance("allow", all_.a)).alias("weight"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block; null where a rule decides) of every row of pages."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Paths differ by numbers only: their tokens are few, so URLs are grouped by host and path tokens first.
    path_words = F.filter(F.split(F.regexp_replace(F.lower("path"), "[0-9]+", " 0 "), r"[^\p{L}0]+"), lambda x: x != "")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("page_id", "host", "path", path_words.alias("path_words"), rule.alias("r"))
    forms = materialize(urls.groupBy("host", "path_words", F.col("r.verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("count")), "url-forms")
    names = forms.select("host").distinct().select("host", F.explode(F.split("host", r"[^\p{L}]+")).alias("name"))
    counts = materialize(word_counts(pages), "url-words")
    split = segmented(names.select("name").distinct(), counts)
    hosts = names.join(split, "name").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("host_words"))
    tokens = F.concat(F.transform(F.coalesce("host_words", F.array().cast("array<string>")), lambda x: F.concat(F.lit("h:"), x)), F.transform("path_words", lambda x: F.concat(F.lit("p:"), x)))
    forms = materialize(forms.join(hosts, "host", "left").select("host", "path_words", "verdict", "count", tokens.alias("tokens")), "url-tokens")

    decided = forms.where("verdict is not null")
    prior = {r.verdict: r.n for r in decided.groupBy("verdict").agg(F.sum("count").alias("n")).collect()}
    both = len(prior) == 2
    weights = naive_bayes(decided.select(F.explode("tokens").alias("token"), "verdict", "count").groupBy("token", "verdict").agg(F.sum("count").alias("count")))
    open_ = forms.where("verdict is null").select("host", "path_words", "tokens")
    spread = open_.select("host", "path_words", F.explode("tokens").alias("token")).join(weights, "token").groupBy("host", "path_words").agg(F.sum("weight").alias("sum"))
    offset = float(np.log(prior["block"] / prior["allow"])) if both else 0.0
    scored = open_.select("host", "path_words").join(spread, ["host", "path_words"], "left").select("host", "path_words", (F.coalesce("sum", F.lit(0.0)) + offset).alias("score"))
    if not both:
        scored = scored.withColumn("score", F.lit(0.0))
    verdict = F.coalesce("r.verdict", F.when(F.round("score", 9) > 0, "block").otherwise("allow"))
    joined = urls.join(scored, ["host", "path_words"], "left")
    return joined.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("r").isNull(), F.col("score")).alias("score"))
