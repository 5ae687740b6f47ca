"""Applying quantizers to packets."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from seqdrift.functions import quantizing as Q
from seqdrift.functions.numeric import uniform
from seqdrift.schema import FEATURE_QUANTIZER, FEATURES, SHORT

_SYMBOL_COLUMNS = ("t", "d", "s")
#: quantizer rows (at most about 23 KB each) that are sure to fit a broadcast; longer models join by shuffle
BROADCAST_POSITIONS = 1024
#: copies of a longer model, over which the rows of a position are spread
COPIES = 64


def domain_guard(features: DataFrame, mode: str = "fail") -> DataFrame:
    """Values outside their domain: `fail` stops, `drop` leaves the rows out, `clamp` moves them to the edge.

    Applies to masked features too.
    """
    good = Q.symbol_in_domain(F.col("t"), F.col("d"), F.col("s"))
    if mode == "fail":
        message = F.concat(F.lit("value out of range at "), F.col("conn_id"), F.lit(":"), F.col("idx").cast("string"))
        return features.where(F.when(good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    if mode == "drop":
        return features.where(good)
    if mode == "clamp":
        return (
            features.withColumn("t", F.greatest(F.when(F.isnan("t"), F.lit(0.0)).otherwise(F.col("t")), F.lit(0.0)))
            .withColumn("d", F.greatest(F.least("d", F.lit(1)), F.lit(0)))
            .withColumn("s", F.greatest(F.least("s", F.lit(1460)), F.lit(1)))
        )
    raise ValueError(f"unknown mode {mode!r}")


def domain_violations(features: DataFrame) -> DataFrame:
    """Number of values outside the domain, per feature."""
    def out(f: str) -> Column:
        x = F.col(SHORT[f])
        bad = ~Q.in_domain(f, x)
        return F.count_if(bad | F.isnan(x) if f == "timestamp" else bad)

    counts = features.agg(F.array(*[F.struct(F.lit(f).alias("feature"), out(f).alias("outside")) for f in FEATURES]).alias("r"))
    return counts.select(F.explode("r").alias("r")).select("r.feature", "r.outside")


def _literal(r: Row | dict) -> Column:
    lookup = F.array(*[F.lit(v) for v in r["lookup"]]) if r["lookup"] is not None else F.lit(None)
    bins = F.lit(None)
    if r["bins"] is not None:
        bins = F.array(*[
            F.struct(F.array(*[F.lit(v) for v in b["values"]]).cast("array<int>").alias("values"),
                     F.array(*[F.lit(v) for v in b["counts"]]).cast("array<bigint>").alias("counts"))
            for b in r["bins"]])
    fields = {n: F.lit(r[n]) for n in ("kind", "eff_min", "eff_max", "inv_width", "num_bins")}
    return F.struct(*[v.alias(n) for n, v in fields.items()], lookup.alias("lookup"), bins.alias("bins")).cast(
        FEATURE_QUANTIZER.simpleString())


class Quantizer:
    """A quantizer per position (a table keyed by idx), or one for all positions (a single row).

    `positions` is the length of a per-position table when the caller knows it; short tables broadcast.
    """

    def __init__(self, table: DataFrame | None = None, positions: int | None = None, single: Row | dict | None = None,
                 kinds: dict[str, set[str]] | None = None):
        if (table is None) == (single is None):
            raise ValueError("give either a table or a single row")
        self.table, self.positions, self.single = table, positions, single
        self.kinds = kinds if single is None else {c: {single[c]["kind"]} for c in _SYMBOL_COLUMNS}

    @classmethod
    def per_packet(cls, table: DataFrame, positions: int | None = None) -> Quantizer:
        return cls(table=table, positions=positions)

    @classmethod
    def measured(cls, table: DataFrame) -> Quantizer:
        """Of a settled table: its length and the kinds that occur are read at once (one small row)."""
        row = table.agg(F.count("*").alias("n"), *[F.collect_set(F.col(c)["kind"]).alias(c) for c in _SYMBOL_COLUMNS]).first()
        return cls(table=table, positions=row["n"], kinds={c: set(row[c]) for c in _SYMBOL_COLUMNS} if row["n"] else None)

    @classmethod
    def everywhere(cls, row: Row) -> Quantizer:
        return cls(single=row)

    def columns(self) -> dict[str, Column]:
        """The feature quantizers as columns of a frame that went through `attach`."""
        return {c: F.col(f"_q{c}") for c in _SYMBOL_COLUMNS}

    def attach(self, df: DataFrame) -> DataFrame:
        """Joins the quantizer of each position. Positions beyond a per-position table drop out."""
        if self.table is None:
            return df.select("*", *[_literal(self.single[c]).alias(f"_q{c}") for c in _SYMBOL_COLUMNS])
        return self._joined(df, self.table.select("idx", *[F.col(c).alias(f"_q{c}") for c in _SYMBOL_COLUMNS]), ["idx"])

    def _joined(self, df: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        if self.positions is not None and self.positions <= BROADCAST_POSITIONS:
            return df.join(F.broadcast(side), on, how)
        # a position holds a row of every flow, so the table is repeated and each position spread over its copies
        side = side.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        key = [c for c, kind in df.dtypes if not kind.startswith("map")]
        spread = df.withColumn("_copy", F.pmod(F.xxhash64(*key), F.lit(COPIES)).cast("int"))
        return spread.join(side, [*on, "_copy"], how).drop("_copy")

    def attach_drawing(self, df: DataFrame, size_bin: str) -> DataFrame:
        """Joins what a draw needs of a quantizer `for_drawing`: its scalars, and as `_own` the observed values of the row's size bin.

        The tables of a position are as large as thousands of packets and would be copied into every row.
        """
        if self.table is None:
            return self.attach(df).withColumn("_own", F.expr(f"get(_qs.bins, {size_bin})")).withColumn("_own", Q.searchable("_own"))
        scalars = self.table.select("idx", *[
            Q.make(*[F.col(c)[n] for n in ("kind", "eff_min", "eff_max", "inv_width", "num_bins")]).alias(c) for c in _SYMBOL_COLUMNS])
        out = Quantizer(table=scalars, positions=self.positions, kinds=self.kinds).attach(df)
        if self.kinds is not None and "empirical" not in self.kinds["s"]:
            return out
        bins = self.table.select("idx", F.posexplode(F.col("s")["bins"]).alias("_bin", "_b")).select("idx", "_bin", Q.searchable("_b").alias("_own"))
        return self._joined(out.withColumn("_bin", F.expr(size_bin)), bins, ["idx", "_bin"], "left").drop("_bin")

    def symbol(self, t: str = "t", d: str = "d", s: str = "s", when: str | None = None) -> Column:
        return Q.symbol(t, d, s, when, self.kinds)

    def value(self, feature: str, b: str) -> Column:
        """A value inside the bin named `b`, of a frame with uniforms that went through `attach_drawing`."""
        c = SHORT[feature]
        return Q.to_value(feature, b, f"_q{c}", f"_u{c}", self.kinds and self.kinds[c])

    def for_drawing(self) -> Quantizer:
        """The same quantizer prepared for drawing values inside bins."""
        if self.table is None:
            bins = self.single["s"]["bins"]
            if bins is None:
                return self
            counts = [{"values": b["values"], "counts": list(accumulate(b["counts"]))} for b in bins]
            row = {c: self.single[c].asDict(recursive=True) for c in _SYMBOL_COLUMNS}
            row["s"]["bins"] = counts
            return Quantizer(single=row)
        ready = self.table.withColumn("s", Q.running_counts(F.col("s")))
        return Quantizer(table=ready, positions=self.positions, kinds=self.kinds)

    def detach(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f"_q{c}" for c in _SYMBOL_COLUMNS])


def symbols(features: DataFrame, quantizer: Quantizer, guard: str = "fail") -> DataFrame:
    """Adds `sym`, the three bins of each packet."""
    attached = quantizer.attach(domain_guard(features, guard))
    return quantizer.detach(attached.withColumn("sym", quantizer.symbol()))


def bin_counts(quantizer: DataFrame) -> DataFrame:
    """Bins per feature, outcomes and active features of each position."""
    q = {c: F.col(c) for c in _SYMBOL_COLUMNS}
    return quantizer.select(
        "idx", F.col("t.num_bins").alias("time_bins"), F.col("d.num_bins").alias("direction_bins"),
        F.col("s.num_bins").alias("size_bins"), Q.outcomes(q).alias("outcomes"),
        Q.active_features(q).cast("long").alias("active_features"),
    )


def min_features(quantizer: DataFrame, num_packets: int) -> DataFrame:
    """Features of a row of num_packets packets; the quantizer must be strictly longer."""
    q = {c: F.col(c) for c in _SYMBOL_COLUMNS}
    total = F.sum(F.when(F.col("idx") < num_packets, Q.active_features(q)))
    longer = F.max("idx") + 1 > num_packets
    return quantizer.agg(
        F.when(longer, total).otherwise(F.raise_error(F.lit("quantizer too short")).cast("long")).cast("long").alias("features")
    )


def bin_intervals(quantizer: DataFrame) -> DataFrame:
    """Every bin of every position with its readable interval: (idx, feature, bin, label)."""
    parts = None
    for f in FEATURES:
        q = F.col(SHORT[f])
        first = F.when(q["kind"] == "identity", q["eff_min"].cast("int")).otherwise(F.lit(0))
        listed = quantizer.where(q["kind"] != "mask").select(
            "idx", F.lit(f).alias("feature"), q.alias("q"),
            F.explode(F.sequence(first, (first + q["num_bins"] - 1).cast("int"))).alias("bin"),
        )
        parts = listed if parts is None else parts.unionByName(listed)
    return parts.select("idx", "feature", "bin", Q.interval_text(F.col("bin"), F.col("q")).alias("label"))


def dequantized(quantized: DataFrame, quantizer: Quantizer, seed: int) -> DataFrame:
    """Replaces `sym` by values drawn inside its bins: t, d, s. Draws depend only on seed, id and position."""
    key = (F.lit(seed), F.col("conn_id"), F.col("idx"))
    placed = quantized.select("*", *[uniform(*key, F.lit(f)).alias(f"_u{c}") for f, c in SHORT.items()])
    attached = quantizer.for_drawing().attach_drawing(placed, "sym.s")
    drawn = [quantizer.value(f, f"sym.{c}").alias(c) for f, c in SHORT.items()]
    return attached.select(*[c for c in quantized.columns if c != "sym"], *drawn)


def symbol_vectors(quantized: DataFrame, take: int) -> DataFrame:
    """Bins of the first `take` packets of each flow as one array, masked entries left out.

    Only `take` rows per flow are collected into an array.
    """
    rows = quantized.where(F.col("idx") < take).groupBy("conn_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "sym"))).alias("r")
    )
    return rows.select("conn_id", Q.symbol_vector(F.transform("r", lambda x: x["sym"]), take).alias("vector"))
