"""Distribution statistics per (feature, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqdrift.schema import FEATURES, MAX_SIZE, SHORT
from seqdrift.session import settled

QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)
QUANTILE_NAMES = ("q01", "q25", "q50", "q75", "q99")
#: relative rank error of the sketch is 1 / ACCURACY
ACCURACY = 10_000
#: size of a saved sketch; its rank error is about 0.13 %
SKETCH_K = 4000
#: values per position up to which one task may hold all distinct ones
EXACT_ROWS = 2_000_000


def _unpivot(wide: DataFrame, keys: list[str], names: list[str], columns: tuple[str, ...] = ("t", "d", "s")) -> DataFrame:
    """The per-feature column groups of an aggregated frame as rows."""
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{SHORT[f]}_{n}").cast("double").alias(n) for n in names])
        for f in FEATURES if SHORT[f] in columns
    ])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.feature", *[f"r.{n}" for n in names])


def _moment_columns() -> list[Column]:
    out = []
    for c in SHORT.values():
        x = F.col(c).cast("double")
        out += [F.count(x).alias(f"{c}_cnt"), F.avg(x).alias(f"{c}_mean"),
                (F.var_pop(x) * F.count(x)).alias(f"{c}_m2"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    return out


def _sketch_columns() -> list[Column]:
    return [F.percentile_approx(F.col(c).cast("double"), list(QUANTILES), ACCURACY).alias(f"{c}_quantiles") for c in SHORT.values()]


def moments(features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, m2, min, max. One pass over packets with partial sums; only totals are unpivoted."""
    return _moments_of(features.groupBy(*by, "idx").agg(*_moment_columns()), [*by, "idx"])


def sketched_quantiles(features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles from a mergeable sketch of fixed size: the choice for large populations."""
    return _quantiles_of(features.groupBy(*by, "idx").agg(*_sketch_columns()), [*by, "idx"])


def quantile_sketches(features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One sketch per feature and position, a binary column that can be saved and merged: (by, feature, idx, sketch)."""
    return _sketches_of(features.groupBy(*by, "idx").agg(*_kll_columns()), by)


def _kll_columns() -> list[Column]:
    return [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SKETCH_K)).alias(c) for c in SHORT.values()]


def _sketches_of(wide: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("sketch")) for f, c in SHORT.items()])
    return wide.select(*by, "idx", F.explode(rows).alias("r")).select(*by, "r.feature", "idx", "r.sketch")


def partial_summary(features: DataFrame) -> DataFrame:
    """Moments and mergeable sketches of one shard in one pass, one row per position: what a shard saves."""
    return features.groupBy("idx").agg(*_moment_columns(), *_kll_columns())


def of_partials(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged moments and merged sketches of saved partial summaries."""
    return merge_moments(_moments_of(wide, ["idx"])), merge_sketches(_sketches_of(wide))


def merge_sketches(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds saved sketches of any number of shards."""
    return sketches.groupBy(*by, "feature", "idx").agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))


def quantiles_of_sketches(sketches: DataFrame) -> DataFrame:
    """The quantiles that fitting needs, from sketches."""
    ranks = F.array(*[F.lit(float(q)) for q in QUANTILES])
    keys = [c for c in sketches.columns if c != "sketch"]
    found = sketches.withColumn("_q", F.kll_sketch_get_quantile_double("sketch", ranks))
    return found.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(QUANTILE_NAMES)])


def summary(features: DataFrame) -> DataFrame:
    """Moments and sketched quantiles of one pass over the packets, one row per position."""
    return features.groupBy("idx").agg(*_moment_columns(), *_sketch_columns())


def of_summary(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moments and quantiles as rows per feature."""
    return _moments_of(wide, ["idx"]), _quantiles_of(wide, ["idx"])


def _moments_of(wide: DataFrame, keys: list[str]) -> DataFrame:
    out = _unpivot(wide, keys, ["cnt", "mean", "m2", "min", "max"])
    return out.withColumn("cnt", F.col("cnt").cast("long"))


def _quantiles_of(wide: DataFrame, keys: list[str], columns: tuple[str, ...] = ("t", "d", "s"),
                  names: tuple[str, ...] = QUANTILE_NAMES) -> DataFrame:
    flat = wide.select(*keys, *[F.col(f"{c}_quantiles")[i].alias(f"{c}_{n}") for c in columns for i, n in enumerate(names)])
    return _unpivot(flat, keys, list(names), columns)


def variance() -> Column:
    """m2 / (n - 1), 0 for one value."""
    return F.when(F.col("cnt") > 1, F.col("m2") / (F.col("cnt") - 1)).otherwise(F.lit(0.0))


def stddev() -> Column:
    return F.sqrt(variance())


def merge_moments(partials: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds saved partial moments of any number of shards.

    m2 needs the overall mean. Both come from sums that add up across shards, so this is one aggregation:
    sum(m2 + n mean^2) - N MEAN^2, taken about the smallest shard mean to keep the digits.
    """
    keys = [*by, "feature", "idx"]
    n, mean = F.col("cnt"), F.col("mean")
    pivot = partials.groupBy(*keys).agg(F.min("mean").alias("_base"))
    shifted = partials.join(pivot, keys).withColumn("_d", mean - F.col("_base"))
    out = shifted.groupBy(*keys).agg(
        F.sum(n).alias("cnt"),
        F.min("_base").alias("_base"),
        F.sum(n * F.col("_d")).alias("_s"),
        F.sum(F.col("m2") + n * F.col("_d") * F.col("_d")).alias("_ss"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    return out.select(
        *keys, "cnt", (F.col("_base") + F.col("_s") / F.col("cnt")).alias("mean"),
        F.greatest(F.col("_ss") - F.col("_s") * F.col("_s") / F.col("cnt"), F.lit(0.0)).alias("m2"), "min", "max",
    )


def exact_quantiles(features: DataFrame, by: tuple[str, ...] = (), columns: tuple[str, ...] = ("t", "d", "s"),
                    probs: tuple[float, ...] = QUANTILES, names: tuple[str, ...] = QUANTILE_NAMES,
                    limit: int = EXACT_ROWS) -> DataFrame:
    """Interpolated quantiles without a sketch, at any size.

    Where no position has more than `limit` values (measured first), Spark's own exact percentile is
    used; it keeps the distinct values of a position in one task. Beyond that, equal values are added up before the shuffle. What is left is cut along a sketch of each group, and
    only the pieces that hold a wanted rank are ordered, so no task orders a whole position. The cut
    points are written first: they are used twice and must not change between the two.
    """
    largest = features.groupBy(*by, "idx").count().agg(F.max("count")).first()[0] or 0
    if largest <= limit:
        exact = [F.percentile(F.col(c).cast("double"), list(probs)).alias(f"{c}_quantiles") for c in columns]
        wide = features.groupBy(*by, "idx").agg(*exact)
        return _quantiles_of(wide, [*by, "idx"], columns, names)
    keys = [*by, "feature", "idx"]
    feature_of = {SHORT[f]: f for f in FEATURES}
    rows = F.array(*[F.struct(F.lit(feature_of[c]).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    counted = (
        features.select(*by, "idx", F.explode(rows).alias("r")).select(*by, "idx", "r.feature", "r.v")
        .where(F.col("v").isNotNull()).groupBy(*keys, "v").agg(F.count("*").alias("c"))
    )
    # a piece holds about `limit` values at most
    pieces = min(4096, max(64, 2 * largest // max(limit, 1)))
    cuts = counted.groupBy(*keys).agg(
        F.percentile_approx("v", [i / pieces for i in range(1, pieces)], 1000).alias("cuts")
    )
    cuts = settled(cuts, "cuts")
    cut = counted.join(cuts, keys).withColumn(
        "piece", F.size(F.filter("cuts", lambda x: x < F.col("v")))
    ).drop("cuts")
    sizes = cut.groupBy(*keys, "piece").agg(F.sum("c").alias("size"))
    upto = W.partitionBy(*keys).orderBy("piece")
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in zip(names, probs)])
    # a wanted rank p * (n - 1) lies between two whole ranks; both are looked up
    targets = (
        sizes.withColumn("upto", F.sum("size").over(upto))
        .withColumn("total", F.sum("size").over(W.partitionBy(*keys)))
        .withColumn("r", F.explode(ranks))
        .select(*keys, "piece", (F.col("upto") - F.col("size")).alias("before"), "upto", "r.name",
                (F.col("r.p") * (F.col("total") - 1)).alias("rank"))
    )
    lo_in = (F.floor("rank") >= F.col("before")) & (F.floor("rank") < F.col("upto"))
    hi_in = (F.ceil("rank") >= F.col("before")) & (F.ceil("rank") < F.col("upto"))
    targets = targets.where(lo_in | hi_in).groupBy(*keys, "piece", "before").agg(
        F.collect_list(F.struct("name", "rank")).alias("wanted")
    )
    ordered = cut.join(targets, [*keys, "piece"]).withColumn(
        "to", F.col("before") + F.sum("c").over(W.partitionBy(*keys, "piece").orderBy("v"))
    )
    hits = ordered.select(*keys, "v", (F.col("to") - F.col("c")).alias("from"), "to", F.explode("wanted").alias("w"))
    lo = F.when((F.floor("w.rank") >= F.col("from")) & (F.floor("w.rank") < F.col("to")), F.col("v"))
    hi = F.when((F.ceil("w.rank") >= F.col("from")) & (F.ceil("w.rank") < F.col("to")), F.col("v"))
    found = hits.groupBy(*keys, "w.name", "w.rank").agg(F.max(lo).alias("lo"), F.max(hi).alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("rank") - F.floor("rank"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in names])


def size_frequencies(features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Count per size 1..1460 and position. Other sizes are ignored here, and only here."""
    return (
        features.where(F.col("s").between(1, MAX_SIZE))
        .groupBy(*by, "idx", F.col("s").cast("int").alias("value"))
        .agg(F.count("*").alias("freq"))
    )


def frequency_iqr(freq: DataFrame, counts: DataFrame) -> DataFrame:
    """Interquartile range of sizes by counting: first value whose running count reaches floor(n q).

    `counts` (idx, cnt) includes sizes outside the frequency table. At most 1460 rows per position.
    """
    run = W.partitionBy("idx").orderBy("value")
    dense = dense_frequencies(freq, counts.select("idx"))
    walked = dense.withColumn("upto", F.sum("freq").over(run)).join(counts, "idx")

    def at(q: float) -> Column:
        reached = F.col("upto") >= F.floor(F.col("cnt") * q)
        return F.coalesce(F.min(F.when(reached, F.col("value"))), F.lit(MAX_SIZE))

    return walked.groupBy("idx").agg(at(0.25).alias("q1"), at(0.75).alias("q3")).withColumn(
        "iqr", (F.col("q3") - F.col("q1")).cast("double")
    )


def dense_frequencies(freq: DataFrame, positions: DataFrame) -> DataFrame:
    """A row for every size 1..1460 at every position, zeros included."""
    slots = positions.select("idx", F.explode(F.sequence(F.lit(1), F.lit(MAX_SIZE))).alias("value"))
    return slots.join(freq, ["idx", "value"], "left").withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))


def pick(stats: DataFrame, feature: str | None = None, index: int | None = None) -> DataFrame:
    """Rows of one feature, one position, or both."""
    out = stats
    if feature is not None:
        if feature not in FEATURES:
            raise ValueError(f"invalid feature: {feature}")
        out = out.where(F.col("feature") == feature)
    return out if index is None else out.where(F.col("idx") == index)
