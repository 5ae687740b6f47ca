"""Flow filters as plain predicates. Combine them with `&`; any number of terms counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqdrift.schema import KNOWN_VERSIONS


def is_raw() -> Column:
    """A flow without protocol facts."""
    return F.col("ssl_est").isNull()


def everything() -> Column:
    return F.lit(True)


def min_data_packets(n: int) -> Column:
    """At least n packets after the handshake; raw flows always pass.

    Signed arithmetic: a flow shorter than its handshake fails instead of wrapping around.
    """
    return is_raw() | ((F.col("len") - (F.col("ssl_est") + 1)) >= n)


def version_is(version: str) -> Column:
    """Flows of one protocol version; raw flows never pass. Only the two current versions can be asked for."""
    if version not in ("TLSv12", "TLSv13"):
        raise ValueError(f"cannot filter on version {version!r}")
    return ~is_raw() & (F.col("version") == version)


def normal_version(version: Column) -> Column:
    return F.when(version.isin(*KNOWN_VERSIONS), version).otherwise(F.lit("Other"))
