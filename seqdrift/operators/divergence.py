"""Kullback-Leibler divergence between two profiles, per term, per position and cumulative.

Works on counts: its input grows with the number of distinct sequences, not with the data. Joins are left
to Spark, which broadcasts the small sides (totals, short prefix tables) by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqdrift.functions.numeric import INF, NAN


def _meta_of(meta: DataFrame, profile: str, prefix: str) -> DataFrame:
    names = ("total", "alpha", "alphabet_size", "sequence_len", "markov_order")
    return meta.where(F.col("profile") == profile).select("idx", *[F.col(c).alias(f"{prefix}{c}") for c in names])


def _log_ratio(p: Column, numerator: Column, denominator: Column, weight: Column) -> Column:
    """weight * ln(p / (numerator / denominator)); +inf for an impossible symbol, NaN for 0/0."""
    q = numerator / F.when(denominator != 0, denominator)
    return (
        F.when(denominator == 0, F.lit(NAN)).when(numerator == 0, F.lit(INF)).otherwise(weight * F.log(p / q))
    )


def kl_terms(hist: DataFrame, meta: DataFrame, left: str, right: str) -> DataFrame:
    """(idx, ctx, sym, contribution) over the support of `left`, at the positions both profiles have.

    Positions before the order compare whole sequences, later ones compare the last symbol given its
    context. Smoothing, alphabet and context counts are those of `right`. Profiles of different order or
    alphabet are not comparable and raise.
    """
    keys = ["idx", "ctx", "sym"]
    both = _meta_of(meta, left, "p_").join(_meta_of(meta, right, "q_"), "idx")
    same = (F.col("p_markov_order") == F.col("q_markov_order")) & (F.col("p_alphabet_size") == F.col("q_alphabet_size"))
    both = both.where(
        F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("profiles are not comparable")).cast("boolean"))
    )
    p = hist.where(F.col("profile") == left).select(*keys, "cnt")
    q = hist.where(F.col("profile") == right).select(*keys, F.col("cnt").alias("q_cnt"))
    p_prefix = p.groupBy("idx", "ctx").agg(F.sum("cnt").alias("p_prefix"))
    q_prefix = q.groupBy("idx", "ctx").agg(F.sum("q_cnt").alias("q_prefix"))
    joined = (
        p.join(q, keys, "left")
        .join(p_prefix, ["idx", "ctx"])
        .join(q_prefix, ["idx", "ctx"], "left")
        .join(both, "idx")
    )
    cnt, q_cnt = F.col("cnt").cast("double"), F.coalesce("q_cnt", F.lit(0)).cast("double")
    alpha, letters = F.col("q_alpha"), F.col("q_alphabet_size").cast("double")
    empirical = cnt / F.col("p_total")
    words = F.pow(letters, F.col("q_sequence_len").cast("double"))
    whole = _log_ratio(empirical, q_cnt + alpha, F.col("q_total") + alpha * words, empirical)
    last = _log_ratio(cnt / F.col("p_prefix"), q_cnt + alpha, F.coalesce("q_prefix", F.lit(0)) + letters * alpha, empirical)
    contribution = F.when(F.col("idx") < F.col("p_markov_order"), whole).otherwise(last)
    return joined.select(*keys, contribution.alias("contribution"), F.col("p_markov_order").alias("markov_order"))


def reverse_kl_terms(hist: DataFrame, meta: DataFrame, left: str, right: str) -> DataFrame:
    """The other direction: `right` is the reference."""
    return kl_terms(hist, meta, right, left)


def delta(terms: DataFrame) -> DataFrame:
    """(idx, delta): divergence added by each position.

    Before the order, positions hold whole sequences, so the previous sum is taken off (chain rule).
    """
    sums = terms.groupBy("idx").agg(F.sum("contribution").alias("joint"), F.max("markov_order").alias("markov_order"))
    # one row per position
    previous = F.lag("joint").over(W.orderBy("idx"))
    inner = (F.col("idx") > 0) & (F.col("idx") < F.col("markov_order"))
    return sums.select("idx", F.when(inner, F.col("joint") - previous).otherwise(F.col("joint")).alias("delta"))


def cumulative(deltas: DataFrame) -> DataFrame:
    """(idx, cumulative): running sum; the shown value is at least 0, the running one is not cut."""
    running = F.sum("delta").over(W.orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    return deltas.select("idx", F.greatest(running, F.lit(0.0)).alias("cumulative"))


def total(deltas: DataFrame) -> DataFrame:
    return deltas.agg(F.sum("delta").alias("total"))


def max_position(deltas: DataFrame) -> DataFrame:
    """Position with the largest delta; the last one on ties."""
    best = F.max(F.struct("delta", "idx"))
    return deltas.agg(best.alias("b")).select("b.idx", "b.delta")


def terms_at(terms: DataFrame, idx: int) -> DataFrame:
    """All terms of a position, smallest contribution first."""
    return terms.where(F.col("idx") == idx).orderBy("contribution", "ctx", "sym")


def pinsker(v: Column) -> Column:
    return F.sqrt(v / 2.0)


def bretagnolle_huber(v: Column) -> Column:
    return F.sqrt(F.lit(1.0) - F.exp(-v))


def bayes_error_lower_bound(v: Column) -> Column:
    return (F.lit(1.0) - F.least(pinsker(v), bretagnolle_huber(v))) / 2.0


def error_decay(v: Column, n: int) -> Column:
    """exp(-n v): on the forward divergence the decay of one error kind, on the reverse one of the other."""
    return F.exp(F.lit(-float(n)) * v)


def error_bounds(cumulated: DataFrame) -> DataFrame:
    v = F.col("cumulative")
    return cumulated.select("idx", "cumulative", pinsker(v).alias("pinsker"), bretagnolle_huber(v).alias("bretagnolle_huber"),
                            bayes_error_lower_bound(v).alias("bayes_error_lower_bound"))


