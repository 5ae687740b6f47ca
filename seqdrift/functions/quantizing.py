"""Quantizers as expressions: building one, its bin count, value to bin, bin to value, bin to text.

A feature quantizer is a struct column (`schema.FEATURE_QUANTIZER`). Bounds are half-open, so the upper
bound of a discrete feature is one above its largest value.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqdrift.functions.numeric import INF, ln1p
from seqdrift.schema import DISCRETE, DOMAINS, FEATURE_QUANTIZER

MASKED = -1
_DDL = FEATURE_QUANTIZER.simpleString()


def bounds(feature: str, lo: Column | None = None, hi: Column | None = None) -> tuple[Column, Column]:
    """Effective bounds, checked against the domain; the upper one half-open."""
    dmin, dmax = DOMAINS[feature]
    lo = F.lit(dmin) if lo is None else lo
    hi = F.lit(dmax) if hi is None else hi
    good = (lo >= F.lit(dmin)) & (lo <= hi) & (hi <= F.lit(dmax))
    upper = hi + F.lit(1.0) if feature in DISCRETE else hi
    message = F.lit(f"bounds outside the {feature} domain")
    return (
        F.when(good, lo).otherwise(F.raise_error(message).cast("double")),
        F.when(good, upper).otherwise(F.raise_error(message).cast("double")),
    )


def make(kind: str | Column, lo: Column, hi: Column, inv: Column | None = None, num_bins: Column | None = None,
         lookup: Column | None = None, bins: Column | None = None) -> Column:
    null = F.lit(None)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    inv = null if inv is None else inv
    parts = {"kind": kind, "eff_min": lo, "eff_max": hi, "inv_width": inv,
             "num_bins": count_bins(kind, lo, hi, inv.cast("double")) if num_bins is None else num_bins,
             "lookup": null if lookup is None else lookup, "bins": null if bins is None else bins}
    return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(_DDL)


def mask(feature: str) -> Column:
    lo, hi = DOMAINS[feature]
    hi = 1.7976931348623157e308 if hi == INF else hi + 1.0
    return make("mask", F.lit(lo), F.lit(hi), num_bins=F.lit(1))


def identity(feature: str) -> Column:
    if feature not in DISCRETE:
        raise ValueError("identity quantization needs a discrete feature")
    lo, hi = DOMAINS[feature]
    return make("identity", F.lit(lo), F.lit(hi + 1.0), num_bins=F.lit(int(hi + 1.0 - lo)))


def uniform_width(lo: Column, hi: Column, bins: Column) -> Column:
    return F.when(hi > lo, bins / (hi - lo)).otherwise(F.lit(0.0))


def log_width(lo: Column, hi: Column, bins: Column) -> Column:
    width = ln1p(hi) - ln1p(lo)
    return F.when(width > 0, bins / width).otherwise(F.lit(0.0))


def count_bins(kind: Column, lo: Column, hi: Column, inv: Column) -> Column:
    """Outcomes of one feature; empirical quantizers carry their own count."""
    def at_least_one(x: Column) -> Column:
        return F.greatest(F.round(x).cast("long"), F.lit(1).cast("long"))

    return (
        F.when(kind == "mask", F.lit(1).cast("long"))
        .when(kind == "identity", (hi - lo).cast("long"))
        .when(kind == "uniform", at_least_one((hi - lo) * inv))
        .when(kind == "loguniform", at_least_one((ln1p(hi) - ln1p(lo)) * inv))
    )


def in_domain(feature: str, x: Column) -> Column:
    lo, hi = DOMAINS[feature]
    inside = x >= F.lit(lo)
    return inside if hi == INF else inside & (x <= F.lit(hi))


def symbol_in_domain(t: Column, d: Column, s: Column) -> Column:
    """All three features inside their domains; a NaN gap is outside."""
    return in_domain("timestamp", t) & ~F.isnan(t) & in_domain("direction", d) & in_domain("size", s)


KINDS = ("mask", "identity", "empirical", "loguniform", "uniform")


def _bin_sql(x: str, q: str, kinds: Collection[str]) -> str:
    clamped = f"least(greatest(double({x}), {q}.eff_min), {q}.eff_max)"
    last = f"{q}.num_bins - 1"
    rules = {
        "mask": f"{MASKED}",
        "identity": f"int({x})",
        "empirical": f"try_element_at({q}.lookup, int({x}))",
        "loguniform": f"int(greatest(0L, least(floor((ln(1.0D + {clamped}) - ln(1.0D + {q}.eff_min)) * {q}.inv_width), {last})))",
        "uniform": f"int(greatest(0L, least(floor(({clamped} - {q}.eff_min) * {q}.inv_width), {last})))",
    }
    if len(kinds) == 1:
        return rules[next(iter(kinds))]
    return f"case {q}.kind " + " ".join(f"when '{k}' then {rules[k]}" for k in KINDS if k in kinds) + " end"


def symbol(t: str, d: str, s: str, when: str | None = None, kinds: Mapping[str, Collection[str]] | None = None) -> Column:
    """The three bins of a packet of a frame that went through `Quantizer.attach`; null unless `when` holds.

    Takes names (or SQL) of the three values. `kinds` tells which kinds of quantizer occur per feature;
    knowing them keeps the generated code small enough for the compiler.
    """
    parts = ", ".join(f"'{c}', {_bin_sql(x, f'_q{c}', kinds[c] if kinds else KINDS)}" for c, x in (("t", t), ("d", d), ("s", s)))
    made = f"named_struct({parts})"
    return F.expr(f"case when {when} then {made} end" if when else made)


def outcomes(q: dict[str, Column]) -> Column:
    """Size of the alphabet: product of the three bin counts."""
    return q["t"]["num_bins"] * q["d"]["num_bins"] * q["s"]["num_bins"]


def active_features(q: dict[str, Column]) -> Column:
    return sum(((q[c]["kind"] != "mask").cast("int") for c in ("t", "d", "s")), F.lit(0))


def running_counts(q: Column) -> Column:
    """The quantizer with the counts of each empirical bin replaced by their running sums.

    Done once per quantizer row, so that a draw is a binary search.
    """
    def running(counts: Column) -> Column:
        return F.transform(counts, lambda _, i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, c: a + c))

    bins = F.transform(q["bins"], lambda b: F.struct(b["values"].alias("values"), running(b["counts"]).alias("counts")))
    return make(q["kind"], q["eff_min"], q["eff_max"], q["inv_width"], q["num_bins"], q["lookup"], bins)


#: strides of a search in as many values as there are sizes
_STRIDES = ", ".join(str(1 << p) for p in range(10, -1, -1))


def searchable(b: str) -> Column:
    """A bin of running counts, ready for draws: values, counts, total, and the strides of a search that its length asks for."""
    return F.expr(f"""case when {b} is not null then named_struct('values', {b}.values, 'counts', {b}.counts, 'total', try_element_at({b}.counts, -1),
        'strides', filter(array({_STRIDES}), p -> p < size({b}.values))) end""")


def _observed_sql(own: str, u: str) -> str:
    """Observed value of a `searchable` bin, weighted by its counts; null for an empty bin."""
    found = f"aggregate({own}.strides, 0, (pos, p) -> case when get({own}.counts, pos + p - 1) <= {u} * {own}.total then pos + p else pos end)"
    return f"double(get({own}.values, {found}))"


def to_value(feature: str, b: str, q: str, u: str, kinds: Collection[str] | None = None) -> Column:
    """A value inside a bin, picked by the uniform u; takes names of bin, quantizer and uniform.

    The frame went through `Quantizer.attach_drawing`. `kinds` tells which kinds of quantizer occur, to keep the
    generated code small. Masked discrete features draw inside their domain, so the
    value can be quantized again. A masked unbounded feature has no interval to draw from and yields its
    lower bound.
    """
    lo, hi = f"{q}.eff_min", f"{q}.eff_max"
    width = f"(case when {q}.inv_width > 0 then 1.0D / {q}.inv_width end)"

    def within(a: str, z: str) -> str:
        if feature in DISCRETE:
            last = f"greatest(ceil({a}), least(floor({z}), {int(DOMAINS[feature][1])}L))"
            return f"double(ceil({a}) + floor({u} * ({last} - ceil({a}) + 1)))"
        return f"(case when {a} < {z} then {a} + {u} * ({z} - {a}) else {a} end)"

    from_u = f"coalesce({lo} + {b} * {width}, {lo})"
    from_l = f"coalesce(ln(1.0D + {lo}) + {b} * {width}, ln(1.0D + {lo}))"
    to_l = f"coalesce(least({from_l} + {width}, ln(1.0D + {hi})), {from_l})"
    logged = f"exp(case when {from_l} < {to_l} then {from_l} + {u} * ({to_l} - {from_l}) else {from_l} end) - 1.0D"
    rules = {
        "mask": within(lo, hi) if feature in DISCRETE else lo,
        "identity": f"double({b})",
        "empirical": _observed_sql("_own", u) if feature == "size" else "double(null)",
        "loguniform": f"least(greatest({logged}, {lo}), {hi})",
        "uniform": within(from_u, f"coalesce(least({from_u} + {width}, {hi}), {hi})"),
    }
    found = [k for k in KINDS if kinds is None or k in kinds]
    if len(found) == 1:
        return F.expr(rules[found[0]])
    return F.expr(f"case {q}.kind " + " ".join(f"when '{k}' then {rules[k]}" for k in found) + " end")


def interval_text(bin_id: Column, q: Column) -> Column:
    """Readable interval of a bin: [lo, hi) for continuous bins, [lo, hi] for discrete ones."""
    kind, lo, hi, inv = q["kind"], q["eff_min"], q["eff_max"], q["inv_width"]
    b = bin_id.cast("double")
    width = F.when(inv > 0, F.lit(1.0) / inv)
    u_lo = F.coalesce(lo + b * width, lo)
    u_hi = F.coalesce(F.least(u_lo + width, hi), hi)
    l_lo = F.coalesce(F.exp(ln1p(lo) + b * width) - 1.0, lo)
    l_hi = F.coalesce(F.least(F.exp(ln1p(lo) + (b + 1.0) * width) - 1.0, hi), hi)
    values = F.get(q["bins"], bin_id)["values"]

    def text(a: Column, z: Column) -> Column:
        return F.concat(F.lit("["), F.format_string("%.4f", a), F.lit(", "), F.format_string("%.4f", z), F.lit(")"))

    def whole(a: Column, z: Column) -> Column:
        return F.concat(F.lit("["), a.cast("string"), F.lit(", "), z.cast("string"), F.lit("]"))

    return (
        F.when(kind == "mask", F.lit(""))
        .when(kind == "identity", whole(bin_id, bin_id))
        .when(kind == "uniform", text(u_lo, u_hi))
        .when(kind == "loguniform", text(l_lo, l_hi))
        .when(kind == "empirical", whole(F.coalesce(F.get(values, F.lit(0)), F.lit(0)),
                                         F.coalesce(F.get(values, F.size(values) - 1), F.lit(0))))
    )


def _bin_text(b: Column) -> Column:
    return F.when(b < 0, F.lit("MASK")).otherwise(b.cast("string"))


def symbol_text(sym: Column, q: dict[str, Column] | None = None) -> Column:
    """[t=.. d=.. s=..]; with a quantizer each bin is followed by its interval."""
    def part(c: str) -> list[Column]:
        out = [F.lit(f"{c}="), _bin_text(sym[c])]
        return out + [F.lit(":"), interval_text(sym[c], q[c])] if q else out

    return F.concat(F.lit("["), *part("t"), F.lit(" "), *part("d"), F.lit(" "), *part("s"), F.lit("]"))


def sequence_text(ctx: Column, sym: Column, q: dict[str, Column] | None = None) -> Column:
    """<.., ..>: the context followed by the last symbol."""
    whole = F.concat(ctx, F.array(sym))
    return F.concat(F.lit("<"), F.concat_ws(", ", F.transform(whole, lambda x: symbol_text(x, q))), F.lit(">"))


def symbol_vector(symbols: Column, take: int) -> Column:
    """Bins of the first symbols as one flat array without masked entries."""
    flat = F.flatten(F.transform(F.slice(symbols, 1, take), lambda x: F.array(x["t"], x["d"], x["s"])))
    return F.filter(flat, lambda v: v >= 0)
