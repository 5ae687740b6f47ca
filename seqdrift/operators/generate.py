"""Synthetic sequences drawn from a profile.

Every draw is an equi-join with the cumulated counts of the profile, sliced along [0, 1), so a context
that all sequences pass through is spread over SLICES join keys. Draws depend only on the seed, the
sequence number and the position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqdrift.functions.numeric import uniform
from seqdrift.operators.quantize import Quantizer
from seqdrift.schema import SHORT, SYMBOL
from seqdrift.session import settled

SLICES = 64
#: context lengths from which a position asks the whole context tree at once instead of joining level by level
ONE_LOOKUP = 2
#: positions after which the state of order-k generation is written, to keep plans short
WRITE_EVERY = 8


def cumulated(hist: DataFrame, context: tuple[str, ...] = ("idx", "ctx")) -> DataFrame:
    """Adds lo, hi, total per context, symbols in their natural order.

    Summed in two steps, inside a (t, d) pair and over the pairs, so that no task orders the whole
    support of a position: the first step sees at most 1460 sizes, the second only pairs.
    """
    pair = [*context, "_t", "_d"]
    split = hist.select(*context, "sym", "cnt", F.col("sym.t").alias("_t"), F.col("sym.d").alias("_d"))
    pairs = split.groupBy(*pair).agg(F.sum("cnt").alias("_n"))
    earlier = W.partitionBy(*context).orderBy("_t", "_d").rowsBetween(W.unboundedPreceding, -1)
    pairs = pairs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    totals = split.groupBy(*context).agg(F.sum("cnt").alias("total"))
    hi = F.col("_before") + F.sum("cnt").over(W.partitionBy(*pair).orderBy("sym.s"))
    return (
        split.join(pairs, pair).join(totals, list(context)).withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("cnt"))
        .select(*context, "sym", "cnt", "lo", "hi", "total")
    )


def sliced(cdf: DataFrame) -> DataFrame:
    """One row per slice of [0, 1) that an interval touches; slices widened a little against rounding."""
    def at(x: Column, nudge: float) -> Column:
        return F.floor(x * F.lit(float(SLICES)) / F.col("total") + F.lit(nudge)).cast("int")

    first = F.greatest(at(F.col("lo"), -1e-6), F.lit(0))
    last = F.least(at(F.col("hi"), 1e-6), F.lit(SLICES - 1))
    return cdf.withColumn("slice", F.explode(F.sequence(first, last)))


def slice_of(u: Column) -> Column:
    return F.floor(u * F.lit(float(SLICES))).cast("int")


def sequence_id(number: Column) -> Column:
    return F.format_string("synthetic-flow-%08d", number)


def draws(spark: SparkSession, flows: int, length: int, seed: int) -> DataFrame:
    """(conn_id, idx, u): one uniform per sequence and position."""
    cells = spark.range(flows * length)
    n, idx = F.floor(F.col("id") / length).cast("long"), (F.col("id") % length).cast("int")
    cells = cells.select(n.alias("n"), idx.alias("idx"))
    return cells.select(sequence_id(F.col("n")).alias("conn_id"), "idx", uniform(F.lit(seed), F.col("n"), F.col("idx")).alias("u"))


def sample_symbols(cells: DataFrame, cdf: DataFrame) -> DataFrame:
    """Symbol of each cell from the context-free counts of its position."""
    u = F.col("u") * F.col("total")
    joined = cells.withColumn("slice", slice_of(F.col("u"))).join(
        sliced(cdf.select("idx", "sym", "lo", "hi", "total")), ["idx", "slice"]
    )
    return joined.where((u >= F.col("lo")) & (u < F.col("hi"))).select("conn_id", "idx", "sym")


def generate_order0(hist: DataFrame, flows: int, length: int, seed: int) -> DataFrame:
    """Independent symbols per position: (conn_id, idx, sym)."""
    check_profile(hist, 0, length)
    cdf = cumulated(hist.where(F.col("idx") < length))
    return sample_symbols(draws(hist.sparkSession, flows, length, seed), cdf)


def monotonic(values: DataFrame) -> DataFrame:
    """Raises each time to the largest one before it in the same sequence."""
    return values.withColumn("t", F.max("t").over(W.partitionBy("conn_id").orderBy("idx")))


def check_length(meta: DataFrame, length: int) -> None:
    """The profile must reach as far as the sequences. One number is collected."""
    available = meta.agg(F.max("idx")).first()[0]
    if available is None or length > available + 1:
        raise ValueError(f"length {length} exceeds the {0 if available is None else available + 1} positions of the profile")


def check_profile(hist: DataFrame, order: int, length: int) -> None:
    """The profile must reach as far as the sequences and be of the order asked for. One row is collected."""
    found = hist.agg(F.max("idx").alias("idx"), F.max(F.size("ctx")).alias("depth")).first()
    available = 0 if found["idx"] is None else found["idx"] + 1
    if length > available:
        raise ValueError(f"length {length} exceeds the {available} positions of the profile")
    if available and found["depth"] != min(order, available - 1):
        raise ValueError(f"the profile has contexts of {found['depth']}, order {order} asked for")


def shorter_contexts(hist: DataFrame, order: int) -> DataFrame:
    """The profile at every context length: (level, idx, ctx, sym, cnt), contexts being suffixes."""
    levels = F.sequence(F.lit(0), F.size("ctx"))
    spread = hist.withColumn("level", F.explode(levels))
    keep = F.expr("slice(ctx, size(ctx) - level + 1, level)")
    return spread.withColumn("ctx", keep).groupBy("level", "idx", "ctx", "sym").agg(F.sum("cnt").alias("cnt"))


def generate(hist: DataFrame, quantizer: Quantizer, order: int, flows: int, length: int, seed: int,
             raise_time: bool = True) -> DataFrame:
    """Order-k sequences: (conn_id, idx, t, d, s, sym, level).

    The context of a position is the last `order` drawn packets, quantized again with the quantizer of
    that position. A context the profile has not seen falls back to its longest known suffix; `level` is
    the length used, so fallbacks can be counted. `raise_time` keeps times from decreasing.
    """
    if order == 0:
        return _generate_independent(hist, quantizer, flows, length, seed, raise_time)
    spark = hist.sparkSession
    check_profile(hist, order, length)
    levels = settled(shorter_contexts(hist.where(F.col("idx") < length), order), "contexts")
    model = settled(sliced(cumulated(levels, ("level", "idx", "ctx"))), "model", by="idx")
    quantizer = quantizer.for_drawing()
    if quantizer.table is not None:
        quantizer = Quantizer(settled(quantizer.table, "quantizer"), quantizer.positions, kinds=quantizer.kinds)
    state = spark.range(flows).withColumnRenamed("id", "n")
    for i in range(length):
        state = _next_position(state, model, quantizer, i, min(order, i), seed, raise_time)
        if (i + 1) % WRITE_EVERY == 0 and i + 1 < length:
            state = settled(state, "state")
    packets = F.array(*[
        F.struct(F.lit(i).alias("idx"), *[F.col(f"p{i}")[c].alias(c) for c in ("t", "d", "s", "sym", "level")])
        for i in range(length)
    ])
    rows = state.select(sequence_id(F.col("n")).alias("conn_id"), F.explode(packets).alias("p"))
    return rows.select("conn_id", "p.*")


def _next_position(state: DataFrame, model: DataFrame, quantizer: Quantizer, i: int, depth: int, seed: int,
                   raise_time: bool) -> DataFrame:
    known = [c for c in state.columns if c != "idx"]
    # a column rather than a constant, from which the join by position would become a cross product
    here = quantizer.attach(state.withColumn("idx", (F.pmod("n", F.lit(1)) + i).cast("int")))
    past = {f"_past{j}": quantizer.symbol(f"p{j}.t", f"p{j}.d", f"p{j}.s") for j in range(i - depth, i)}
    u = uniform(F.lit(seed), F.col("n"), F.lit(i))
    # the quantizer goes before the joins with the model: a row of it is as large as thousands of packets
    here = quantizer.detach(here.withColumns({**past, "_u": u, "_slice": slice_of(u)}))
    nodes = model.where((F.col("idx") == i) & (F.col("level") <= depth)).drop("idx")
    here = (_by_level if depth < ONE_LOOKUP else _by_one_lookup)(here, nodes, [F.col(c) for c in past])
    uniforms = [uniform(F.lit(seed), F.col("n"), F.lit(i), F.lit(f)).alias(f"_u{c}") for f, c in SHORT.items()]
    here = here.select(*known, "idx", F.col("_found.sym").alias("_sym"), F.col("_found.level").alias("_level"), *uniforms)
    here = quantizer.attach_drawing(here, "_sym.s")
    t, d, s = (quantizer.value(f, f"_sym.{c}") for f, c in SHORT.items())
    if raise_time and i > 0:
        t = F.greatest(t, F.col(f"p{i - 1}.t"))
    packet = F.struct(t.alias("t"), d.alias("d"), s.alias("s"), F.col("_sym").alias("sym"), F.col("_level").alias("level"))
    return here.select(*known, packet.alias(f"p{i}"))


def _by_level(here: DataFrame, nodes: DataFrame, past: list[Column]) -> DataFrame:
    """Adds `_found` (level, sym) by a join for each length of the context: for short contexts, where two joins are all."""
    depth = len(past)
    for level in range(depth, -1, -1):
        ctx = F.array(*past[depth - level:]).cast(f"array<{SYMBOL}>")
        side = nodes.where(F.col("level") == level).select(
            F.col("ctx").alias(f"_ctx{level}"), F.col("slice").alias(f"_slice{level}"), F.col("lo").alias("_lo"),
            F.col("hi").alias("_hi"), F.col("total").alias("_total"), F.col("sym").alias(f"_sym{level}"),
        )
        scaled = F.col("_u") * F.col("_total")
        here = here.withColumn("_ctx", ctx).join(
            side,
            (F.col("_ctx") == F.col(f"_ctx{level}")) & (F.col("_slice") == F.col(f"_slice{level}"))
            & (scaled >= F.col("_lo")) & (scaled < F.col("_hi")),
            "left",
        ).drop("_ctx", f"_ctx{level}", f"_slice{level}", "_lo", "_hi", "_total")
    levels = [F.when(F.col(f"_sym{k}").isNotNull(), F.struct(F.lit(k).alias("level"), F.col(f"_sym{k}").alias("sym"))) for k in range(depth, -1, -1)]
    return here.withColumn("_found", F.coalesce(*levels)).drop(*[f"_sym{k}" for k in range(depth + 1)])


def _by_one_lookup(here: DataFrame, nodes: DataFrame, past: list[Column]) -> DataFrame:
    """Adds `_found` (level, sym) by one lookup in the context tree, whatever the order.

    Each sequence asks for all suffixes of its context at once; of the nodes that exist the longest answers. Only the questions
    meet the tree, packets drawn so far stay where they are and join the answer by their number.
    """
    depth = len(past)
    whole = F.array(*past).cast(f"array<{SYMBOL}>")
    asked = here.select("n", "_u", "_slice", whole.alias("_whole")).select(
        "n", "_u", F.col("_slice").alias("slice"), F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(depth)),
            lambda k: F.struct(k.alias("level"), F.slice(F.col("_whole"), F.lit(depth + 1) - k, k).alias("ctx")),
        )).alias("_q")
    ).select("n", "_u", "slice", "_q.*")
    scaled = F.col("_u") * F.col("total")
    met = asked.join(nodes.select("level", "ctx", "slice", "lo", "hi", "total", "sym"), ["level", "ctx", "slice"])
    met = met.where((scaled >= F.col("lo")) & (scaled < F.col("hi")))
    answers = met.groupBy("n").agg(F.max_by(F.struct("level", "sym"), "level").alias("_found"))
    return here.join(answers, "n")


def _generate_independent(hist: DataFrame, quantizer: Quantizer, flows: int, length: int, seed: int,
                          raise_time: bool) -> DataFrame:
    from seqdrift.operators.quantize import dequantized

    drawn = generate_order0(hist, flows, length, seed)
    values = dequantized(drawn.withColumn("_keep", F.col("sym")), quantizer, seed).withColumnRenamed("_keep", "sym")
    values = monotonic(values) if raise_time else values
    return values.select("conn_id", "idx", "t", "d", "s", "sym", F.lit(0).alias("level"))


def fallbacks(generated: DataFrame, order: int) -> DataFrame:
    """How many draws used a shorter context than the order asks for, per position."""
    wanted = F.least(F.lit(order), F.col("idx"))
    return generated.groupBy("idx").agg(F.count_if(F.col("level") < wanted).alias("fallbacks"), F.count("*").alias("drawn"))
