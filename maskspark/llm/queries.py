"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskspark.llm.common import remainder, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskspark.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=5, percent=75)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskspark.llm.url_filter import RULES, filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskspark.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = remainder("doc_id", 3) != 1
    return toxicity.score(docs, toxicity.train(docs.where(own), labels.where(own)), "crc32(cast(doc_id as string)) % 3 = 1")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskspark.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from maskspark.llm.bpe import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskspark.llm.media import digests, media_columns

    return digests(media_columns(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskspark.llm import language

    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    found = language.identify(docs, language.train(docs.where(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from maskspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskspark.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskspark.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskspark.llm.line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskspark.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_url_filters,
        op3_toxicity,
        op4_pii,
        op5_byte_bpe,
        op6_media_columns,
        op7_language_id,
        op8_best_fit_packing,
        op9_quality_rules,
        op10_secret_scans,
        op11_line_dedup,
        op12_filter_interaction_audit,
    )
}

_GAP = r"[\x20\x09-\x0D]"

SQL: dict[str, str] = {
    "op11_line_dedup": f"""
        with lines as (
            select doc_id, i, line, translate(regexp_replace(line, '^{_GAP}+|{_GAP}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
            from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)
        ),
        repeated as (select k, min(doc_id) as owner from lines where length(k) >= 10 group by k having count(distinct doc_id) > 1),
        judged as (select lines.*, coalesce(doc_id <> owner, false) as gone from lines left join repeated using (k))
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
        from judged group by doc_id""",
    "op12_filter_interaction_audit": f"""
        with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
        words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from texts),
        flags as (
            select doc_id, part, len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b,
                100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
                doc_id > min(doc_id) over (partition by text) as e
            from words
        ),
        failed as (
            select part, list_concat(if(a, ['A'], []), if(b, ['B'], []), if(c, ['C'], []), if(d, ['D'], []), if(e, ['E'], [])) as f,
                coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic
            from flags left join labels using (doc_id)
        ),
        profile as (select part, f, good, toxic, count(*) as n from failed group by all),
        letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
        orders as (
            select a.l || b.l || c.l || d.l || e.l as filter_order from letter a, letter b, letter c, letter d, letter e
            where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
        ),
        steps as (select filter_order, cast(step as int) as step, filter_order[step] as x, string_split(filter_order[1:step - 1], '') as before from orders, range(1, 6) r(step)),
        counted as (
            select part, filter_order, step, x,
                sum(n) filter (where not list_has_any(f, before) and not list_contains(f, x)) as kept,
                sum(n) filter (where not list_has_any(f, before) and list_contains(f, x)) as removed,
                sum(n) filter (where list_has_any(f, before) and list_contains(f, x)) as redundant,
                sum(n) filter (where f = [x]) as unique_fails,
                sum(n) filter (where good and not list_has_any(f, before) and list_contains(f, x)) as good_lost,
                sum(n) filter (where toxic and not list_has_any(f, before) and list_contains(f, x)) as toxic_lost
            from profile, steps group by part, filter_order, step, x
        )
        select part, filter_order, step, {", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
            cast(coalesce(sum(removed) over (partition by part, x), 0) as bigint) as shapley
        from counted""",
}
