"""Counts, ranks, zero-collapse ratios and join-size predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskspark.functions.mask import bit_at, put, rank
from maskspark.operators.joins import shared_pairs, shared_row_counts
from maskspark.storage import cut, numbered
from maskspark.system import System


def arity_distribution(system: System) -> DataFrame:
    """arity (as text, the report's key), relations."""
    return system.relations.groupBy(F.size("bits").cast("string").alias("arity")).agg(F.count(F.lit(1)).alias("relations"))


def table_ranks(system: System) -> DataFrame:
    return system.sized.select("table_id", "bits", "arity", "row_count", rank(F.col("row_count"), F.col("arity")).alias("rank"))


def rank_summary(system: System) -> DataFrame:
    """One row for each arity and one, with arity null, for all: relations, least, most, mean, median rank. An empty system gives one row of zeros."""
    zero = F.lit(0.0)
    stats = (
        F.count(F.lit(1)).alias("relations"),
        *(F.coalesce(f("rank"), zero).alias(n) for f, n in ((F.min, "min_rank"), (F.max, "max_rank"), (F.avg, "mean_rank"), (F.median, "median_rank"))),
    )
    ranks = table_ranks(system)
    return ranks.groupBy("arity").agg(*stats).unionByName(ranks.agg(*stats).withColumn("arity", F.lit(None).cast("int")))


def rank_signatures(system: System, top: int = 10) -> DataFrame:
    """The most frequent (arity, rows) combinations."""
    return table_ranks(system).groupBy("arity", "row_count", "rank").agg(F.count(F.lit(1)).alias("relations")).orderBy(F.desc("relations"), "arity", "row_count").limit(top)


def zero_collapse(system: System) -> DataFrame:
    """For each table and bit: rows before and after the bit is set to 0 everywhere, the rows that fall together, and their share.
    64 rows that differ in their lowest 6 bits only are one word, a bit for each row that occurs: below, a bit set to 0
    moves a word's bits; above, it puts words one on another. So no row is repeated for each of its bits."""
    chunk = F.call_function("shiftrightunsigned", F.col("row"), F.lit(6))
    word = F.bit_or(put(F.lit(1), F.col("row").bitwiseAND(F.lit(63))))
    words = system.rows.groupBy("table_id", chunk.alias("chunk")).agg(word.alias("word"), F.count("row").alias("n"))
    below = lambda p: F.bit_count(F.col("word").bitwiseOR(F.call_function("shiftrightunsigned", F.col("word"), F.lit(1 << p))).bitwiseAND(F.lit(_ZERO[p])))
    low = words.groupBy("table_id").agg(F.sum("n").alias("before"), F.array(*(F.sum(below(p)) for p in range(6))).alias("below"))
    tall = words.join(system.relations.where(F.size("bits") > 6).hint("merge"), "table_id").select("table_id", "chunk", "word", F.explode(F.sequence(F.lit(6), F.size("bits") - 1)).alias("pos"))
    met = tall.groupBy("table_id", "pos", F.col("chunk").bitwiseAND(F.bitwise_not(put(F.lit(1), F.col("pos") - 6))).alias("chunk")).agg(F.bit_or("word").alias("word"))
    high = met.groupBy("table_id", "pos").agg(F.sum(F.bit_count("word")).alias("above"))
    cell = system.relations.join(low.hint("merge"), "table_id", "left").select("table_id", F.posexplode("bits").alias("pos", "bit"), "before", "below")
    m = cell.join(high.hint("merge"), ["table_id", "pos"], "left")
    after = F.coalesce(F.when(F.col("pos") < 6, F.get("below", F.col("pos"))).otherwise(F.col("above")), F.lit(0).cast("long"))
    m = m.select("table_id", "pos", "bit", F.coalesce("before", F.lit(0).cast("long")).alias("before"), after.alias("after"))
    m = m.withColumn("collapsed", F.col("before") - F.col("after"))
    return m.withColumn("ratio", F.when(F.col("before") > 0, F.col("collapsed") / F.col("before")).otherwise(0.0))


#: Of the 64 rows of a word, those whose bit p is 0.
_ZERO = [sum(1 << i for i in range(64) if not i >> p & 1) for p in range(6)]


def zero_collapse_by_table(system: System) -> DataFrame:
    return zero_collapse(system).groupBy("table_id").agg(F.max("ratio").alias("max_ratio"), F.avg("ratio").alias("mean_ratio"), F.count(F.lit(1)).alias("bits"))


def zero_collapse_overall(system: System) -> DataFrame:
    z = zero_collapse(system)
    return z.agg(F.countDistinct("table_id").alias("relations"), F.count(F.lit(1)).alias("metrics"), F.max("ratio").alias("max_ratio"), F.avg("ratio").alias("mean_ratio"), F.sum("before").alias("row_visits"))


def bit_support(system: System) -> DataFrame:
    """bit, relations (sorted ids), support."""
    return system.schema.groupBy("bit").agg(F.array_sort(F.collect_set("table_id")).alias("relations")).withColumn("support", F.size("relations"))


def related_bits(system: System, itself: bool = False) -> DataFrame:
    """bit, related (sorted bits that share a table with it)."""
    a, b = system.schema.select("table_id", "bit"), system.schema.select("table_id", F.col("bit").alias("other"))
    pairs = a.join(b, "table_id").select("bit", "other").distinct()
    pairs = pairs if itself else pairs.where("bit <> other")
    found = pairs.groupBy("bit").agg(F.array_sort(F.collect_list("other")).alias("related"))
    return system.schema.select("bit").distinct().join(found, "bit", "left").withColumn("related", F.coalesce("related", F.array().cast("array<long>")))


def incident_union_arity(system: System) -> DataFrame:
    """bit, relations, union_arity: the bits of the join of all relations that hold the bit."""
    a, b = system.schema.select("table_id", "bit"), system.schema.select("table_id", F.col("bit").alias("other"))
    return a.join(b, "table_id").groupBy("bit").agg(F.countDistinct("table_id").alias("relations"), F.countDistinct("other").alias("union_arity"))


def mergeable_bits(system: System, cap: int = 16) -> DataFrame:
    """Bits whose incident relations fit together within cap bits."""
    return incident_union_arity(system).where(F.col("union_arity") <= cap)


def one_probabilities(system: System) -> DataFrame:
    """table_id, pos, bit, p_one. Ones are counted by place, one group for each table; its bits are named afterwards."""
    most = system.relations.agg(F.max(F.size("bits"))).first()[0] or 0
    ones = F.array(*(F.sum(bit_at(F.col("row"), F.lit(p))) for p in range(most))).cast("array<long>").alias("ones")
    counts = system.rows.groupBy("table_id").agg(F.count("row").alias("n"), ones)
    cell = system.relations.join(counts.hint("merge"), "table_id").select("table_id", F.posexplode("bits").alias("pos", "bit"), "n", "ones")
    return cell.select("table_id", "pos", "bit", F.try_divide(F.get("ones", F.col("pos")), F.col("n")).alias("p_one"))


PREDICTORS = ("uniform", "marginals", "histogram", "rank_left_right", "rank_right_left", "rank_low_high")


def join_predictions(system: System) -> DataFrame:
    """For each pair of relations with a shared bit: six predictions of the join's rows, and the rows."""
    pairs = shared_pairs(system)
    sized = table_ranks(system).select("table_id", "arity", "row_count", "rank")
    for side in ("l", "r"):
        pairs = pairs.join(sized.select(*(F.col(c).alias(f"{side}_{c}") for c in sized.columns)), f"{side}_table_id")
    probability = one_probabilities(system).select("table_id", "bit", "p_one")
    shared = pairs.select("l_table_id", "r_table_id", F.explode("shared").alias("bit"))
    both = shared.join(probability.toDF("l_table_id", "bit", "p"), ["l_table_id", "bit"]).join(probability.toDF("r_table_id", "bit", "q"), ["r_table_id", "bit"])
    match = both.groupBy("l_table_id", "r_table_id").agg(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("bit", (F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))).alias("m")))), lambda x: x["m"]), F.lit(1.0), lambda a, m: a * m).alias("match"))
    actual = shared_row_counts(system)
    df = pairs.join(match, ["l_table_id", "r_table_id"], "left").join(actual, ["l_table_id", "r_table_id"], "left")
    two = lambda n: F.pow(F.lit(2.0), n)
    shared_n, la, ra = F.size("shared"), F.col("l_arity"), F.col("r_arity")
    ln, rn = F.col("l_row_count").cast("double"), F.col("r_row_count").cast("double")
    forward, backward = ln * F.pow("r_rank", ra - shared_n), rn * F.pow("l_rank", la - shared_n)
    low_left = (F.col("l_rank") < F.col("r_rank")) | ((F.col("l_rank") == F.col("r_rank")) & (F.col("l_table_id") < F.col("r_table_id")))
    cap = F.least(two(la + ra - shared_n), ln * two(ra - shared_n), rn * two(la - shared_n))
    capped = lambda x: F.least(F.greatest(x, F.lit(0.0)), cap)
    histogram = F.coalesce(F.col("join_rows"), F.lit(0).cast("long"))
    return df.select(
        "l_table_id", "r_table_id", shared_n.alias("shared_bits"), (la + ra - shared_n).alias("union_arity"),
        capped(ln * rn / two(shared_n)).alias("uniform"),
        capped(ln * rn * F.coalesce("match", F.lit(0.0))).alias("marginals"),
        histogram.cast("double").alias("histogram"),
        capped(forward).alias("rank_left_right"),
        capped(backward).alias("rank_right_left"),
        capped(F.when(low_left, forward).otherwise(backward)).alias("rank_low_high"),
        histogram.alias("actual"),
    )


def prediction_errors(system: System) -> DataFrame:
    """predictor, shared_bits (null: all), and error statistics."""
    p = join_predictions(system)
    long_ = p.select("shared_bits", "union_arity", "actual", F.explode(F.array(*(F.struct(F.lit(n).alias("predictor"), F.col(n).alias("predicted")) for n in PREDICTORS))).alias("x")).select("shared_bits", "union_arity", F.col("actual").cast("double").alias("actual"), "x.*")
    power = lambda c: F.when(F.col(c) <= 0, 0.0).otherwise(F.pow(c, F.lit(1.0) / F.greatest("union_arity", F.lit(1))))
    log = F.log2(F.col("predicted") + 1) - F.log2(F.col("actual") + 1)
    q = F.greatest((F.col("predicted") + 1) / (F.col("actual") + 1), (F.col("actual") + 1) / (F.col("predicted") + 1))
    e = long_.select("predictor", "shared_bits", F.abs(F.col("predicted") - F.col("actual")).alias("rows"), F.abs(power("predicted") - power("actual")).alias("ranks"), log.alias("log"), q.alias("q"), (F.col("predicted") < 0.5).alias("said_empty"), (F.col("actual") == 0).alias("is_empty"))
    count = lambda c: F.sum(c.cast("long"))
    said, is_ = F.col("said_empty"), F.col("is_empty")
    stats = [
        F.count(F.lit(1)).alias("pairs"), F.avg("rows").alias("mean_abs_rows"), F.avg("ranks").alias("mean_abs_rank"), F.avg(F.abs("log")).alias("mean_abs_log2"), F.sqrt(F.avg(F.col("log") * F.col("log"))).alias("rmse_log2"),
        F.avg("q").alias("mean_q"), F.max("q").alias("max_q"),
        F.try_divide(count(said & is_), count(said)).alias("empty_precision"), F.try_divide(count(said & is_), count(is_)).alias("empty_recall"),
    ]
    e = cut(e, "errors")
    whole = e.withColumn("shared_bits", F.lit(None).cast("int"))
    parts = []
    for df in (e, whole):
        keys = ["predictor", "shared_bits"]
        at = _nearest_ranks(df, "q", keys, {"median_q": 0.5, "p95_q": 0.95}).toDF("at_predictor", "at_shared_bits", "median_q", "p95_q")
        found = df.groupBy(*keys).agg(*stats)
        parts.append(found.join(at, (F.col("predictor") == F.col("at_predictor")) & F.col("shared_bits").eqNullSafe(F.col("at_shared_bits"))).drop("at_predictor", "at_shared_bits"))
    return parts[0].unionByName(parts[1])


def _nearest_ranks(df: DataFrame, value: str, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """keys and, for each quantile q, the value at place round((n - 1) * q) of its n ascending ones.
    Rows are numbered over ranges of all keys and values, so no task gathers a group."""
    ranked = numbered(df.select(*keys, value), *keys, value)
    groups = ranked.groupBy(*keys).agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.col("start") + F.round((F.col("n") - 1) * q).cast("long")).alias("number")) for name, q in quantiles.items())))
    chosen = groups.select(wanted.alias("x")).select("x.*").join(ranked, "number")
    return chosen.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in quantiles))


def worst_predictions(system: System, predictor: str = "uniform", limit: int = 10) -> DataFrame:
    p = join_predictions(system)
    over = F.greatest((F.col(predictor) + 1) / (F.col("actual") + 1), (F.col("actual") + 1) / (F.col(predictor) + 1))
    return p.select("l_table_id", "r_table_id", "shared_bits", "union_arity", F.col(predictor).alias("predicted"), "actual", over.alias("q_error")).orderBy(F.desc("q_error"), "l_table_id", "r_table_id").limit(limit)


def system_metrics(system: System) -> DataFrame:
    """One row: relations, rows, bits, least and most arity."""
    s = system.sized.agg(F.count(F.lit(1)).alias("relations"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_total"), F.min("arity").alias("min_arity"), F.max("arity").alias("max_arity"))
    bits = system.schema.agg(F.countDistinct("bit").alias("bits"))
    one = F.lit(1).alias("one")
    return s.select("*", one).join(bits.select("*", one), "one").drop("one")


def metric_deltas(before: System, after: System) -> DataFrame:
    """One row: how relations, bits, rows and the ranks' least, greatest, mean and median changed. A system without ranks counts as 0."""
    parts = []
    for sign, system in ((-1, before), (1, after)):
        side = F.lit(sign).alias("side")
        m = system_metrics(system).select(side, "relations", "bits", "row_total")
        r = rank_summary(system).where("arity is null").select(side, "min_rank", "max_rank", "mean_rank", "median_rank")
        parts.append(m.join(r, "side", "left"))
    both = parts[0].unionByName(parts[1])
    change = lambda c: F.sum(F.col("side") * F.coalesce(F.col(c), F.lit(0))).alias(f"{c}_delta")
    return both.agg(*(change(c) for c in both.columns if c != "side"))


def best_by(df: DataFrame, *order, per: list[str]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where("_r = 1").drop("_r")
