"""From a flow table to a wide matrix of real or synthetic flows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqdrift.functions.numeric import snapped
from seqdrift.operators import export as E
from seqdrift.operators.flows import preprocess, usable_rtt, with_rtt
from seqdrift.operators.quantize import Quantizer, symbols
from seqdrift.operators.sampling import bernoulli, smallest
from seqdrift.schema import FEATURES


def export_flows(flows: DataFrame, packets: DataFrame, num_packets: int, keep: Column | None = None, rate: float = 1.0,
                 rows: int | None = None, seed: int = 0, strip: bool = False, min_packets: int = 0,
                 include_rtt: bool = False, skip_timing: bool = False, quantizer: Quantizer | None = None,
                 quantized: bool = False, mask: Iterable[str] = (), chunk: int | None = None) -> DataFrame:
    """Filter, sample, strip, gaps, minimum length, row cap, matrix.

    One row per chosen flow, all padding where it has no packets (left). Flows without a positive round trip are left
    out only where normalised times are written. Sampling comes before the minimum length and the cap after it, so a cap counts written rows. A cap
    takes the rows with the smallest hash, which are those of every lower rate first: one pass, no row
    twice. Without a quantizer all unmasked features are written as they are.
    """
    if quantized and quantizer is None:
        raise ValueError("quantized export needs a quantizer")
    if not 0.0 < rate <= 1.0:
        raise ValueError("rate must be in (0, 1]")
    active = set(FEATURES) - set(mask) - ({"timestamp"} if skip_timing else set())
    chosen = flows if keep is None else flows.where(keep)
    if rows is None:
        chosen = bernoulli(chosen, rate, seed)
    chosen = with_rtt(chosen)
    if "timestamp" in active and not include_rtt:
        chosen = usable_rtt(chosen)  # only written times need a round trip
    features = preprocess(chosen, packets, strip=strip, normalise=not include_rtt, chunk=chunk)
    if min_packets > 0:
        features = E.long_enough(features, min_packets)
        chosen = chosen.join(features.select("conn_id").distinct(), "conn_id", "left_semi")
    if rows is not None:
        chosen = chosen.join(smallest(chosen.select("conn_id"), rows, seed), "conn_id", "left_semi")
        features = features.join(chosen.select("conn_id"), "conn_id", "left_semi")
    features = features.where(F.col("idx") < num_packets)
    side = chosen.select("conn_id", *[snapped(F.col("rtt")).alias("rtt")] * include_rtt)
    if quantized:
        matrix = E.quantized_matrix(symbols(features, quantizer), num_packets, active, quantizer.positions)
    else:
        matrix = E.raw_matrix(features, num_packets, active, include_rtt=include_rtt)
    return E.for_every_flow(matrix, side)


def export_synthetic(generated: DataFrame, length: int, active: Iterable[str], quantized: bool = False) -> DataFrame:
    """Matrix of generated sequences, as values or as bins."""
    if quantized:
        return E.quantized_matrix(generated, length, active)
    return E.raw_matrix(generated, length, active)
