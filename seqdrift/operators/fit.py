"""Fitting a quantizer per position under a sample-size budget.

Everything here works on per-position summaries (counts, quantiles, size frequencies), so its input is
bounded by positions x 1460 however large the population is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqdrift.functions import numeric as N
from seqdrift.functions import quantizing as Q
from seqdrift.operators import stats as S
from seqdrift.operators.quantize import Quantizer
from seqdrift.schema import DEFAULT_DELTA, DEFAULT_EPSILON, FEATURES, MAX_SIZE
from seqdrift.session import settled, settled_together


def unmasked(mask: Iterable[str]) -> set[str]:
    """Features left after masking."""
    mask = set(mask)
    if mask - set(FEATURES):
        raise ValueError(f"invalid feature: {sorted(mask - set(FEATURES))}")
    return set(FEATURES) - mask


def samples_per_position(moments: DataFrame, active: set[str]) -> DataFrame:
    """Fewest values over the unmasked features, per position."""
    return moments.where(F.col("feature").isin(sorted(active))).groupBy("idx").agg(F.min("cnt").alias("n"))


def cut_positions(counts: DataFrame, epsilon: float, delta: float, max_packets: int | None = None,
                  strict: bool = True) -> DataFrame:
    """Positions below `max_packets`; too few samples at any of them is an error.

    Without `strict` the positions before the first one that has too few are kept instead; `left_out` counts the rest.
    """
    if max_packets is not None and max_packets <= 0:
        raise ValueError("max_packets must be greater than 0")
    if max_packets is not None:
        counts = counts.where(F.col("idx") < max_packets)
    enough = F.col("n") >= N.min_samples(epsilon, delta)
    if strict:
        message = F.concat(F.lit("not enough samples at position "), F.col("idx").cast("string"))
        return counts.where(F.when(enough, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    first_thin = counts.where(~enough).agg(F.min("idx").alias("_thin"))  # one row
    return counts.join(F.broadcast(first_thin)).where(F.col("_thin").isNull() | (F.col("idx") < F.col("_thin"))).drop("_thin")


def left_out(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Positions and samples that a cut leaves out: one row (positions, samples)."""
    return counts.join(kept.select("idx"), "idx", "left_anti").agg(
        F.count("*").alias("positions"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))


def budgets(counts: DataFrame, order: int, epsilon: float, active: set[str]) -> DataFrame:
    """Adds k (outcomes of a whole n-gram), root (per packet) and budget (after the direction share).

    A budget that would reach 0 is raised to 1; the product guard then decides.
    """
    degree = F.least(F.lit(order), F.col("idx")) + 1
    out = counts.withColumn("k", N.outcome_budget(F.col("n"), epsilon))
    out = out.withColumn("root", F.when(degree == 1, F.col("k")).otherwise(N.integer_root(F.col("k"), degree)))
    share = F.floor(F.col("root") / 2) if "direction" in active else F.col("root")
    return out.withColumn("budget", F.greatest(share.cast("long"), F.lit(1).cast("long")))


def size_bins(budget: DataFrame, iqr: DataFrame, active: set[str]) -> DataFrame:
    """Adds size_fd and size_bins. Alone, size takes the whole budget; beside time, at most its square root."""
    lo, hi = Q.bounds("size")
    out = budget.join(iqr.select("idx", "iqr"), "idx", "left").withColumn(
        "size_fd", N.freedman_diaconis(lo, hi, F.col("n"), F.coalesce("iqr", F.lit(0.0)))
    )
    top = F.lit(MAX_SIZE).cast("long")
    if "size" not in active:
        bins = F.lit(1).cast("long")
    elif "timestamp" not in active:
        bins = F.least(F.col("budget"), top)
    else:
        bins = F.least(F.col("size_fd"), F.least(N.isqrt(F.col("budget")), top))
    return out.withColumn("size_bins", F.greatest(bins, F.lit(1).cast("long"))).drop("iqr")


def maxdiff(freq: DataFrame, bins: DataFrame) -> DataFrame:
    """MaxDiff bins: (idx, value, freq, bin) for every size.

    `bins - 1` boundaries go where neighbouring frequencies differ most; of equal differences the lower
    size wins. `bins` is (idx, size_bins). At most 1460 rows per position.
    """
    by_value = W.partitionBy("idx").orderBy("value")
    dense = S.dense_frequencies(freq, bins.select("idx"))
    jump = dense.withColumn("jump", F.abs(F.col("freq") - F.lag("freq").over(by_value)))
    ranked = jump.withColumn(
        "rank", F.row_number().over(W.partitionBy("idx").orderBy(F.col("jump").desc_nulls_last(), "value"))
    ).join(bins.select("idx", "size_bins"), "idx")
    starts = F.col("jump").isNotNull() & (F.col("rank") < F.col("size_bins"))
    return ranked.withColumn("bin", F.sum(F.when(starts, 1).otherwise(0)).over(by_value).cast("int")).select(
        "idx", "value", "freq", "bin"
    )


def maxdiff_tables(assigned: DataFrame) -> DataFrame:
    """Per position: lookup from size to bin, and the observed values and counts of each bin."""
    seen = F.col("freq") > 0
    per_bin = assigned.groupBy("idx", "bin").agg(
        F.sort_array(F.collect_list(F.struct("value", "bin"))).alias("slots"),
        F.sort_array(F.collect_list(F.when(seen, F.struct("value", "freq")))).alias("seen"),
    )
    tables = per_bin.groupBy("idx").agg(
        F.sort_array(F.flatten(F.collect_list("slots"))).alias("slots"),
        F.sort_array(F.collect_list(F.struct("bin", "seen"))).alias("by_bin"),
    )
    return tables.select(
        "idx",
        F.transform("slots", lambda x: x["bin"]).alias("lookup"),
        F.transform("by_bin", lambda b: F.struct(
            F.transform(b["seen"], lambda x: x["value"]).alias("values"),
            F.transform(b["seen"], lambda x: x["freq"]).alias("counts"),
        )).alias("bins"),
    )


def time_bounds(quantiles: DataFrame) -> DataFrame:
    """Bounds of the time feature: 1st percentile but at least 0, and 99th percentile."""
    t = quantiles.where(F.col("feature") == "timestamp")
    return t.select("idx", F.greatest("q01", F.lit(0.0)).alias("t_min"), F.col("q99").alias("t_max"),
                    (F.col("q75") - F.col("q25")).alias("t_iqr"))


def time_bins(budget: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds time_fd, time_bins and the log-uniform width."""
    out = budget.join(bounds, "idx").withColumn(
        "time_fd", N.freedman_diaconis(F.col("t_min"), F.col("t_max"), F.col("n"), F.col("t_iqr"))
    )
    room = F.floor(F.col("budget") / F.col("size_bins")).cast("long")
    return out.withColumn("time_bins", F.greatest(F.least(F.col("time_fd"), room), F.lit(1).cast("long"))).withColumn(
        "t_inv", Q.log_width(F.col("t_min"), F.col("t_max"), F.col("time_bins"))
    )


def guarded(quantizer: DataFrame, k: str = "k") -> DataFrame:
    """Fails when the bins of a position multiply to more than its outcome budget."""
    q = {c: F.col(c) for c in ("t", "d", "s")}
    message = F.concat(F.lit("exceeded outcome budget at position "), F.col("idx").cast("string"))
    fits = Q.outcomes(q) <= F.col(k)
    return quantizer.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def fit(features: DataFrame, order: int = 0, epsilon: float = DEFAULT_EPSILON, delta: float = DEFAULT_DELTA,
        mask: Iterable[str] = (), max_packets: int | None = None, strict: bool = True, exact: bool = False) -> DataFrame:
    """Quantizer of a feature frame: one row (idx, t, d, s) per position, computed at once and settled.

    Quantiles of time come from a sketch, or exactly with `exact`. Reads the features twice (once more
    with `exact`); save a feature frame that is expensive to make.
    """
    timed = "timestamp" in unmasked(mask)
    freq, quantiles = (S.size_frequencies(features), "frequencies"), None
    if not timed:
        moments, freq = settled_together((S.moments(features), "moments"), freq)
    elif exact:
        moments, freq, quantiles = settled_together(
            (S.moments(features), "moments"), freq, (S.exact_quantiles(features, columns=("t",)), "quantiles"))
    else:
        wide, freq = settled_together((S.summary(features), "summary"), freq)
        moments, quantiles = S.of_summary(wide)
    return settled(fit_from_stats(moments, freq, quantiles, order, epsilon, delta, mask, max_packets, strict), "quantizer")


def fitted(features: DataFrame, order: int = 0, **options) -> Quantizer:
    """`fit`, ready to apply."""
    return Quantizer.measured(fit(features, order, **options))


def plan_bins(moments: DataFrame, freq: DataFrame, quantiles: DataFrame | None, order: int, epsilon: float, delta: float,
              mask: Iterable[str] = (), max_packets: int | None = None, strict: bool = True) -> DataFrame:
    """Bin counts per position before the quantizers are built."""
    active = unmasked(mask)
    counts = cut_positions(samples_per_position(moments, active), epsilon, delta, max_packets, strict)
    size_counts = moments.where(F.col("feature") == "size").select("idx", "cnt")
    planned = size_bins(budgets(counts, order, epsilon, active), S.frequency_iqr(freq, size_counts), active)
    return time_bins(planned, time_bounds(quantiles)) if "timestamp" in active else planned


def fit_from_stats(moments: DataFrame, freq: DataFrame, quantiles: DataFrame | None, order: int = 0,
                   epsilon: float = DEFAULT_EPSILON, delta: float = DEFAULT_DELTA, mask: Iterable[str] = (),
                   max_packets: int | None = None, strict: bool = True) -> DataFrame:
    """Quantizer from saved or merged statistics."""
    active = unmasked(mask)
    planned = settled(plan_bins(moments, freq, quantiles, order, epsilon, delta, mask, max_packets, strict), "plan")
    t, s = Q.mask("timestamp"), Q.mask("size")
    if "timestamp" in active:
        t = Q.make("loguniform", F.col("t_min"), F.col("t_max"), F.col("t_inv"))
    if "size" in active:
        tables = maxdiff_tables(maxdiff(freq, planned.where(F.col("size_bins") < MAX_SIZE)))
        planned = planned.join(tables, "idx", "left")
        lo, hi = Q.bounds("size")
        empirical = Q.make("empirical", lo, hi, num_bins=F.size("bins").cast("long"), lookup=F.col("lookup"), bins=F.col("bins"))
        s = F.when(F.col("size_bins") < MAX_SIZE, empirical).otherwise(Q.identity("size"))
    d = Q.identity("direction") if "direction" in active else Q.mask("direction")
    built = planned.select("idx", "k", t.alias("t"), d.alias("d"), s.alias("s"))
    return guarded(built).drop("k")


def uniform_quantizer(counts: DataFrame, size_bins: int, features: Iterable[str] = ("direction", "size")) -> DataFrame:
    """The same hand-chosen quantizer at every position of `counts`: uniform sizes, optional direction."""
    features = set(features)
    lo, hi = Q.bounds("size")
    s = Q.make("uniform", lo, hi, Q.uniform_width(lo, hi, F.lit(float(size_bins))))
    return counts.select(
        "idx", Q.mask("timestamp").alias("t"),
        (Q.identity("direction") if "direction" in features else Q.mask("direction")).alias("d"),
        (s if "size" in features else Q.mask("size")).alias("s"),
    )
