"""Table schemas, feature domains and other fixed facts shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Feature names, their domains and the largest packet payload.
MAX_SIZE = 1460
FEATURES = ("timestamp", "direction", "size")
DOMAINS = {
    "timestamp": (0.0, float("inf")),
    "direction": (0.0, 1.0),
    "size": (1.0, float(MAX_SIZE)),
}
DISCRETE = ("direction", "size")
# Protocol versions that keep their own name; anything else reads "Other".
KNOWN_VERSIONS = ("SSL", "TLSv10", "TLSv11", "TLSv12", "TLSv13", "unknown-64282")
# Fixed value: packets kept of one flow by the assembler.
HORIZON = 50
# Default accuracy, failure probability, pseudocount.
DEFAULT_EPSILON = 0.05
DEFAULT_DELTA = 0.05
DEFAULT_ALPHA = 1.0

#: features by short name, the column names used in feature frames and symbols
SHORT = {"timestamp": "t", "direction": "d", "size": "s"}


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


FLOW_LOG = _struct(
    ("conn_id", T.StringType()),
    ("syn_ts", T.DoubleType()),
    ("synack_ts", T.DoubleType()),
    ("ack_ts", T.DoubleType()),
    ("version", T.StringType()),
    ("client_hello", T.IntegerType()),
    ("server_hello", T.IntegerType()),
    ("ssl_est", T.IntegerType()),
    ("len", T.LongType()),
)

PACKET_LOG = _struct(
    ("conn_id", T.StringType()),
    ("idx", T.IntegerType()),
    ("ts", T.DoubleType()),
    ("direction", T.IntegerType()),
    ("size", T.IntegerType()),
)

PACKET_EVENTS = _struct(
    ("conn_id", T.StringType()),
    ("arrival", T.LongType()),
    ("ts", T.DoubleType()),
    ("is_orig", T.BooleanType()),
    ("flags", T.StringType()),
    ("seq", T.LongType()),
    ("len", T.LongType()),
    ("payload_prefix", T.BinaryType()),
    ("event", T.StringType()),
    ("version", T.StringType()),
)

# The batch probe writes all fields; the one-domain probe leaves out proxyServer and url.
PROBE_LOG = _struct(
    ("proxy", T.StringType()),
    ("proxyServer", T.StringType()),
    ("domain", T.StringType()),
    ("url", T.StringType()),
    ("ok", T.BooleanType()),
    ("status", T.IntegerType()),
    ("error", T.StringType()),
    ("startedAt", T.TimestampType()),
    ("finishedAt", T.TimestampType()),
    ("tlsVersion", T.StringType()),
    ("postQuantum", T.StringType()),
)

#: one value of a quantizer row; `kind` is mask, identity, uniform, loguniform or empirical
FEATURE_QUANTIZER = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("eff_min", T.DoubleType()),
        T.StructField("eff_max", T.DoubleType()),
        T.StructField("inv_width", T.DoubleType()),
        T.StructField("num_bins", T.LongType()),
        T.StructField("lookup", T.ArrayType(T.IntegerType())),
        T.StructField(
            "bins",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("values", T.ArrayType(T.IntegerType())),
                        T.StructField("counts", T.ArrayType(T.LongType())),
                    ]
                )
            ),
        ),
    ]
)

QUANTIZER = T.StructType(
    [T.StructField("idx", T.IntegerType())] + [T.StructField(c, FEATURE_QUANTIZER) for c in ("t", "d", "s")]
)

SYMBOL = "struct<t:int,d:int,s:int>"
