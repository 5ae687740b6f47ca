"""Profiles of populations and their divergence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from seqdrift.operators import divergence as D
from seqdrift.operators import profile as P
from seqdrift.operators.quantize import Quantizer
from seqdrift.schema import DEFAULT_ALPHA
from seqdrift.session import settled


@dataclass(frozen=True)
class Profile:
    hist: DataFrame
    meta: DataFrame
    order: int


def build_profile(features: DataFrame, quantizer: Quantizer, order: int, population: str | None = None,
                  alpha: float = DEFAULT_ALPHA, guard: str = "fail", length: int | None = None) -> Profile:
    """Profile of a feature frame. With `population`, a column, one profile per value of it in one pass.

    Counts are settled: comparing and sampling read them several times, and must not count the packets anew.
    """
    by = (population,) if population else ()
    length = quantizer.positions if length is None else length
    grams = P.ngrams(features, quantizer, order, by, guard, length)
    hist = settled(P.histogram(grams, grams[population] if population else "all"), "profile")
    return Profile(hist, settled(P.metadata(hist, quantizer, order, alpha), "metadata"), order)


def divergence_terms(profile: Profile, left: str, right: str) -> DataFrame:
    return D.kl_terms(profile.hist, profile.meta, left, right)


def position_divergence(profile: Profile, left: str, right: str) -> DataFrame:
    """At which position do two populations differ most? (idx, delta)"""
    return D.delta(divergence_terms(profile, left, right))


def merge_profiles(*profiles: Profile, into: str | None = None) -> Profile:
    """Adds the profiles of any number of shards. All must be of one order."""
    if len({p.order for p in profiles}) != 1:
        raise ValueError("profiles of different order cannot be merged")
    return Profile(P.merge(*[p.hist for p in profiles], into=into),
                   P.merge_metadata(*[p.meta for p in profiles], into=into), profiles[0].order)
